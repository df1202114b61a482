"""Cross-validation of the three fitted agents, calibration, decisions and persistence.

Features are computed once per run and written to the shared checkpoint
folder (parquet); every fold then only filters them, so a lost executor
recomputes from those files, not from the raw corpus. The loop over folds is
a loop over k (= 4) groups of Spark jobs, not over data.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ALPHA, FUSION_WEIGHTS, N_FOLDS, SEED
from ..functions.text import clean_tokens
from ..functions.urls import FEATURES_54
from ..operators.email_urls import agg_names, email_url_features_inrow
from ..operators.folds import calibration_flags, stratified_folds
from ..operators.metrics import cv_pooled, cv_summary
from ..operators.models import EmbeddingAgent, SequenceAgent
from ..operators.newton import NewtonAgent, fit_folds
from ..operators.policy import enforcement, policy_tiers
from ..operators.vocab import attach_sequences, fold_token_freq, fold_vocab
from ..session import in_this_scope, scratch_path
from ..sources.published import current, publish
from ..sources.tables import emails, table, urls
from .evaluate import decide, fold_metrics, fuse, thresholds

LEX_COLS = agg_names(FEATURES_54)
AGENTS = ("semantic", "textual", "lexical")


def featurise(mail: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Tokens and the 108 URL features of raw mail, row by row (also on a stream)."""
    e = mail.select(*keep, "raw_text", clean_tokens(F.col("raw_text")).alias("tokens"))
    return email_url_features_inrow(e, FEATURES_54, keep=(*keep, "tokens"))


def feature_tables(spark: SparkSession, sf_dir: str, k: int = N_FOLDS, seed: int = SEED) -> dict[str, DataFrame]:
    """Email and URL feature tables with folds, each written once to the checkpoint folder.

    Features are materialised before folds are ranked: the rank's bucket-count
    and size-check passes then read two pruned parquet columns instead of
    re-running URL extraction and the 108 aggregates. Calibration flags are
    comparisons with k cut values, so a fold is a filter on the row.
    """
    lex = featurise(emails(spark, sf_dir), ("email_id", "y"))
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    u = urls(spark, sf_dir).select("url_id", "y", F.col("url").alias("raw_text"))
    ulex = email_url_features_inrow(u, FEATURES_54, keep=("url_id", "y"))
    paths = {n: scratch_path(spark, f"cv-{n}") for n in ("emails0", "urls0", "emails", "urls")}

    def folded(rows: DataFrame, key: str, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(paths[f"{name}0"])
        stratified_folds(spark.read.parquet(paths[f"{name}0"]), key, "y", k, seed).write.mode("overwrite").parquet(paths[name])
        return spark.read.parquet(paths[name])
    with ThreadPoolExecutor(2) as pool:
        both = pool.submit(in_this_scope(folded), lex.join(emb, "email_id", "left"), "email_id", "emails"), \
            pool.submit(in_this_scope(folded), ulex, "url_id", "urls")
        e, u = (f.result() for f in both)
    flags = calibration_flags(e.select("email_id", "fold"), "email_id", k, seed=seed)
    return {"emails": e.withColumns({cal_flag(t): c for t, c in flags.items()}), "urls": u}


def cal_flag(fold: int) -> str:
    """Column that tells whether a training row of ``fold`` calibrates (null on its test rows)."""
    return f"cal_{fold}"


def fold_vocabularies(t: dict[str, DataFrame], folds: list[int]) -> dict[int, DataFrame]:
    """Every fold's id vocabulary from one count of all tokens."""
    ef, spark = t["emails"], t["emails"].sparkSession
    outside = {f: F.coalesce(F.col(cal_flag(f)), F.lit(True)) for f in folds}   # null on the fold's test rows
    path = scratch_path(spark, "cv-vocab")
    fold_token_freq(ef, outside).write.parquet(f"{path}/freq")
    freq = spark.read.parquet(f"{path}/freq")
    for f in folds:
        fold_vocab(freq, f).write.parquet(f"{path}/fold={f}")
    return {f: spark.read.parquet(f"{path}/fold={f}") for f in folds}


def fit_agents(t: dict[str, DataFrame], folds: list[int]) -> dict[int, dict]:
    """The three agents of every fold: lexical on the URL table, the others on all fit rows.

    Vocabularies and lexical models of all folds come from common passes; the other
    fits know nothing of each other, so their iterations run side by side.
    """
    ef = t["emails"]

    def semantic(f: int) -> EmbeddingAgent:
        return EmbeddingAgent().fit(ef.where(~F.col(cal_flag(f))))

    def textual(f: int, vocab: DataFrame) -> SequenceAgent:
        return SequenceAgent(max_rows=None).fit(attach_sequences(ef.where(~F.col(cal_flag(f))).select("y", "tokens"), vocab))
    with ThreadPoolExecutor(2 * len(folds) + 2) as pool:
        lexical = pool.submit(in_this_scope(fit_folds), t["urls"], LEX_COLS, "fold", folds)
        sem = {f: pool.submit(in_this_scope(semantic), f) for f in folds}
        vocab = fold_vocabularies(t, folds)
        txt = {f: pool.submit(in_this_scope(textual), f, vocab[f]) for f in folds}
        lex = lexical.result()
        return {f: {"fold": f, "vocab": vocab[f], "lexical": lex[f], "semantic": sem[f].result(), "textual": txt[f].result()}
                for f in folds}


def score_agents(df: DataFrame, m: dict, weights=FUSION_WEIGHTS) -> DataFrame:
    """p_semantic, p_textual, p_lexical and p_fused for the rows of ``df`` (one row each)."""
    s = m["semantic"].score(df, "p_semantic")
    s = m["textual"].score(attach_sequences(s, m["vocab"]), "p_textual")
    s = m["lexical"].score(s, "p_lexical")
    return fuse(s, weights)


def run_fold(t: dict[str, DataFrame], m: dict, alpha: float = ALPHA, weights=FUSION_WEIGHTS,
             save_dir: str | None = None) -> dict[str, DataFrame]:
    """Calibrate, decide and evaluate one fold with its fitted agents; save them if asked."""
    fold = m["fold"]
    ef = t["emails"]
    cal_rows = ef.where(F.col(cal_flag(fold)))
    test_rows = ef.where(F.col("fold") == fold)
    cal = score_agents(cal_rows, m, weights).select(F.lit(fold).alias("train_fold"), "email_id", "y", "p_fused")
    th = thresholds(cal, alpha)
    test = score_agents(test_rows, m, weights).select("fold", "email_id", "y", "p_semantic", "p_textual",
                                                      "p_lexical", "p_fused")
    decided = decide(test, th)
    spark = ef.sparkSession
    out = scratch_path(spark, f"cv-fold{fold}")
    # Materialise this fold's results: lineage stops here and the plan stays small.
    th.write.mode("overwrite").parquet(f"{out}/thresholds")
    th = spark.read.parquet(f"{out}/thresholds")
    decided.write.mode("overwrite").parquet(f"{out}/decided")
    decided = spark.read.parquet(f"{out}/decided")
    fold_metrics(decided, th).write.mode("overwrite").parquet(f"{out}/metrics")
    fm = spark.read.parquet(f"{out}/metrics")
    if save_dir:
        for a in AGENTS:
            m[a].save(f"{save_dir}/fold={fold}/{a}")
        m["vocab"].write.mode("overwrite").parquet(f"{save_dir}/fold={fold}/vocab")
        th.write.mode("overwrite").parquet(f"{save_dir}/fold={fold}/thresholds")
    return {"thresholds": th, "decided": decided, "fold_metrics": fm, "test_rows": test_rows}


def train_and_save(spark: SparkSession, sf_dir: str, fold: int) -> tuple[dict, str, dict[str, DataFrame]]:
    """One fold trained and published in a fresh model folder: (its run, the folder, the feature tables)."""
    root = scratch_path(spark, "cv-models")
    t = feature_tables(spark, sf_dir)
    agents = fit_agents(t, [fold])[fold]
    run: dict = {}
    publish(spark, root, lambda folder: run.update(run_fold(t, agents, save_dir=folder)))
    return run, root, t


def cross_validate(spark: SparkSession, sf_dir: str, k: int = N_FOLDS, seed: int = SEED,
                   alpha: float = ALPHA, weights=FUSION_WEIGHTS, save_dir: str | None = None) -> dict[str, DataFrame]:
    t = feature_tables(spark, sf_dir, k, seed)
    models = fit_agents(t, list(range(1, k + 1)))
    # folds are independent groups of jobs; their small jobs fill each other's gaps
    def run(folder: str | None) -> list[dict[str, DataFrame]]:
        with ThreadPoolExecutor(k) as pool:
            return list(pool.map(in_this_scope(lambda m: run_fold(t, m, alpha, weights, folder)), models.values()))
    runs: list[dict[str, DataFrame]] = []
    if save_dir:   # all folds are published together
        publish(spark, save_dir, lambda folder: runs.extend(run(folder)))
    else:
        runs = run(None)
    fm = reduce(DataFrame.unionByName, [r["fold_metrics"] for r in runs])
    th = reduce(DataFrame.unionByName, [r["thresholds"] for r in runs])
    dec = reduce(DataFrame.unionByName, [r["decided"] for r in runs])
    return {"fold_metrics": fm, "summary": cv_summary(fm), "pooled": cv_pooled(fm), "thresholds": th,
            "decided": dec, "tables": t}


def load_fold(spark: SparkSession, root: str, fold: int = 1) -> dict:
    """Agents, vocabulary and thresholds of the version that the model folder points to now."""
    version = current(spark, root)
    if version is None:
        raise FileNotFoundError(f"no models are published in {root}")
    base = f"{version}/fold={fold}"
    return {"version": version,
            "semantic": EmbeddingAgent.load(spark, f"{base}/semantic"),
            "textual": SequenceAgent.load(spark, f"{base}/textual"),
            "lexical": NewtonAgent.load(spark, f"{base}/lexical"),
            "vocab": spark.read.parquet(f"{base}/vocab"),
            "thresholds": spark.read.parquet(f"{base}/thresholds")}


class PublishedScorer:
    """Decisions on raw mail by the agents and thresholds of a model folder; nothing is trained.

    Mail has ``email_id``, ``raw_text`` and optionally ``embedding`` and columns to
    keep. Each call follows the folder's pointer: agents are read again when the version has
    changed, so a stream that calls this per micro-batch takes up a new publication with its
    next batch.
    """

    def __init__(self, spark: SparkSession, root: str, fold: int = 1, keep: tuple[str, ...] = ("email_id",)):
        self.spark, self.root, self.fold, self.keep = spark, root, fold, keep
        self.models: dict | None = None

    def _current(self) -> dict:
        if self.models is None or self.models["version"] != current(self.spark, self.root):
            self.models = load_fold(self.spark, self.root, self.fold)
            self.models["tau"] = self.models["thresholds"].select("tau_cal", "tau_block").first()
        return self.models

    def __call__(self, mail: DataFrame) -> DataFrame:
        m = self._current()
        cal, block = (F.lit(m["tau"][c]) for c in ("tau_cal", "tau_block"))
        if "embedding" not in mail.columns:
            mail = mail.withColumn("embedding", F.lit(None).cast("array<float>"))
        s = score_agents(featurise(mail, (*self.keep, "embedding")), m)
        scores = [F.round(c, 6).alias(c) for c in ("p_fused", "p_semantic", "p_textual", "p_lexical")]
        return s.select(*self.keep, *scores, F.round(cal, 6).alias("tau_cal"), F.round(block, 6).alias("tau_block"),
                        policy_tiers(F.col("p_fused"), cal, block).alias("action")) \
                .withColumn("sdn_action", enforcement(F.col("action")))
