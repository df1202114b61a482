"""Catalog entries: fitted agents, stacking, cross-validation, model persistence.

Fitted models have no SQL oracle (rows-only checks, plus tests in ``tests/``);
the scaler statistics and the fixed-tier policy are SQL-checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import V0_MIRROR, V0_QUARANTINE
from ..functions.text import clean_tokens
from ..functions.urls import FEATURES_5_V0, FEATURES_5_V2, FEATURES_54
from ..operators.email_urls import agg_names, email_url_features_inrow, score_with_prior
from ..operators.models import EmbeddingAgent, LinearAgent, SequenceAgent, StackedAgent, TfidfAgent, scaler_table
from ..operators.newton import NewtonAgent
from ..operators.policy import policy_v0
from ..operators.tfidf import doc_terms
from ..operators.vocab import attach_sequences, text_token_freq, top_vocab, vocab_ids
from ..session import scratch_path
from ..sources import csv as C
from ..sources import fixtures as X
from ..sources.tables import emails, mail, table, urls
from . import oracle_sql as O
from .cv import PublishedScorer, cross_validate, load_fold, score_agents, train_and_save
from .evaluate import fuse
from .q_eval import FOLDS_CTE, FUSED
from .q_urls import KIND54, _email_agg_sql
from .registry import register

LEX = agg_names(FEATURES_54)
LEX_V0 = agg_names(FEATURES_5_V0)


def url_training_table(spark, sf_dir, spec=FEATURES_54):
    """URL table as lexical training rows: each URL string goes through URL extraction first."""
    u = urls(spark, sf_dir).select("url_id", "y", F.col("url").alias("raw_text"))
    return email_url_features_inrow(u, spec, keep=("url_id", "y"))


_SCALER_SQL = _email_agg_sql(O.url_features_54_sql("url"), KIND54, O.URLS_CTE + ",\nu AS (SELECT url_id AS email_id, y, url AS raw_text FROM urls)", "u")
_SCALER_SQL = "WITH agg AS (" + _SCALER_SQL.replace("WITH ", "WITH ", 1) + ")\n" + \
    "SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM (UNPIVOT agg ON " + \
    ", ".join(LEX) + " INTO NAME feature VALUE value) GROUP BY feature"


@register("agg_scaler_fit", _SCALER_SQL)
def agg_scaler_fit(spark, sf_dir):
    t = scaler_table(url_training_table(spark, sf_dir), LEX)
    return t.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("ml_lexical_score")
def ml_lexical_score(spark, sf_dir):
    agent = NewtonAgent(LEX).fit(url_training_table(spark, sf_dir))
    return agent.score(email_url_features_inrow(mail(spark, sf_dir)), "p_lexical").select("email_id", "y", "p_lexical")


@register("ml_lexical_score_v0")
def ml_lexical_score_v0(spark, sf_dir):
    agent = NewtonAgent(LEX_V0, scale=False).fit(url_training_table(spark, sf_dir, FEATURES_5_V0))
    feats = email_url_features_inrow(mail(spark, sf_dir), FEATURES_5_V0)
    return agent.score(feats, "p_lexical").select("email_id", "y", "p_lexical")


@register("ml_lexical_feature_table")
def ml_lexical_feature_table(spark, sf_dir):
    ft = C.load_feature_table(spark, X.write_feature_table(spark, sf_dir))
    cols = [c for c in ft.columns if c != "y"]
    agent = NewtonAgent(cols).fit(ft)
    return agent.score(ft, "p_lexical")


@register("ml_lexical_table_score")
def ml_lexical_table_score(spark, sf_dir):
    """Mail scored by the model of the pre-computed table: its 10-wide URL vector is cut or filled up
    to that model's width, an email without URLs gets the prior 0.5."""
    ft = C.load_feature_table(spark, X.write_feature_table(spark, sf_dir))
    agent = NewtonAgent([c for c in ft.columns if c != "y"]).fit(ft)
    feats = email_url_features_inrow(mail(spark, sf_dir), FEATURES_5_V2)
    return score_with_prior(agent, feats, agg_names(FEATURES_5_V2)).select("email_id", "y", "n_urls", "p_lexical")


def _terms(spark, sf_dir):
    """Terms made in the row from texts that are stored once."""
    path = scratch_path(spark, "surface")
    emails(spark, sf_dir).select("email_id", "y", "raw_text").write.parquet(path)
    return doc_terms(spark.read.parquet(path), "email_id", "raw_text", "y")


@register("ml_surface_score")
def ml_surface_score(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    return TfidfAgent().fit(terms).score(terms, "p_surface").select("email_id", "y", "p_surface")


def _tokens_table(spark, sf_dir):
    e = emails(spark, sf_dir)
    return e.select("email_id", "y", clean_tokens(F.col("raw_text")).alias("tokens"))


@register("ml_textual_score")
def ml_textual_score(spark, sf_dir):
    vocab = vocab_ids(top_vocab(text_token_freq(emails(spark, sf_dir), "raw_text")))
    path = scratch_path(spark, "textual")
    attach_sequences(_tokens_table(spark, sf_dir), vocab).select("email_id", "y", "ids").write.parquet(path)
    x = spark.read.parquet(path)   # read by the fit and the scoring
    return SequenceAgent(max_rows=None).fit(x).score(x, "p_textual").select("email_id", "y", "p_textual")


def _embedded(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    return emails(spark, sf_dir).select("email_id", "y").join(emb, "email_id", "left")


@register("ml_semantic_score")
def ml_semantic_score(spark, sf_dir):
    e = _embedded(spark, sf_dir)
    return EmbeddingAgent().fit(e).score(e, "p_semantic").select("email_id", "y", "p_semantic")


@register("ml_stacked_score")
def ml_stacked_score(spark, sf_dir):
    """Stacking: an LR over the semantic, surface and lexical scores of the training rows.

    The model is saved, and the rows are scored by what is read back. Rows are stored with their
    text, from which each pass makes the terms.
    """
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    e = emails(spark, sf_dir).select("email_id", "y", "raw_text")
    rows = email_url_features_inrow(e, FEATURES_5_V0, keep=("email_id", "y", "raw_text")).join(emb, "email_id", "left")
    path = scratch_path(spark, "stacked")
    rows.write.parquet(f"{path}/rows")   # read by three fits and the scoring
    rows = spark.read.parquet(f"{path}/rows")
    rest = [c for c in rows.columns if c not in ("email_id", "raw_text")]
    rows = doc_terms(rows, "email_id", "raw_text", *rest)
    lexical = LinearAgent(LEX_V0, scale=False).fit(url_training_table(spark, sf_dir, FEATURES_5_V0))
    StackedAgent(lexical).fit(rows).save(f"{path}/model")
    s = StackedAgent.load(spark, f"{path}/model").score(rows, "risk_score")
    return s.select("email_id", "y", F.round("risk_score", 4).alias("risk_score"),
                    policy_v0(F.col("risk_score")).alias("action"))


@register("ml_policy_v0", O.with_ctes(O.SCORED_CTE) + f"""
SELECT email_id, round({FUSED}, 4) AS risk_score,
       CASE WHEN {FUSED} >= {V0_QUARANTINE} THEN 'quarantine' WHEN {FUSED} >= {V0_MIRROR} THEN 'mirror' ELSE 'deliver' END AS action
FROM scored""")
def ml_policy_v0(spark, sf_dir):
    from ..sources.tables import scored
    s = fuse(scored(spark, sf_dir))
    return s.select("email_id", F.round("p_fused", 4).alias("risk_score"), policy_v0(F.col("p_fused")).alias("action"))


# ---- cross-validation; every query trains what it needs, nothing is kept between queries ----

AGENT_SCORES = ("p_semantic", "p_textual", "p_lexical")


@register("ml_fold_run")
def ml_fold_run(spark, sf_dir):
    return cross_validate(spark, sf_dir)["fold_metrics"]


@register("ml_cross_validate")
def ml_cross_validate(spark, sf_dir):
    return cross_validate(spark, sf_dir)["summary"]


# a model that is read back scores every test row of its fold as before it was saved
@register("sink_models", O.with_ctes(O.SCORED_CTE, FOLDS_CTE) + """
SELECT 1 AS fold, agent, count(*) AS n_rows, CAST(0 AS DOUBLE) AS max_diff
FROM f CROSS JOIN (VALUES ('semantic'), ('textual'), ('lexical')) a(agent) WHERE f.fold = 1 GROUP BY agent""")
def sink_models(spark, sf_dir):
    """Fold 1's agents, saved and read back, over its test rows: per agent the rows scored and
    the largest difference between the score at training time and the reloaded one."""
    run, save, _ = train_and_save(spark, sf_dir, 1)
    before = run["decided"]
    again = score_agents(run["test_rows"], load_fold(spark, save, 1))
    both = before.select("email_id", *[F.col(c).alias(f"was_{c}") for c in AGENT_SCORES]) \
                 .join(again.select("email_id", *AGENT_SCORES), "email_id")
    one = both.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(c) - F.col(f"was_{c}"))).alias(c) for c in AGENT_SCORES])
    per_agent = F.inline(F.array(*[F.struct(F.lit(1).alias("fold"), F.lit(c[2:]).alias("agent"), F.col("n").alias("n_rows"),
                                            F.round(c, 6).alias("max_diff")) for c in AGENT_SCORES]))
    return one.select(per_agent)


@register("src_reload_score")
def src_reload_score(spark, sf_dir):
    """Score every labelled email by what a model folder holds: agents, vocabulary and thresholds
    are read from its published version, nothing of the training run is passed on."""
    _, folder, _ = train_and_save(spark, sf_dir, 1)
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    arriving = emails(spark, sf_dir).select("email_id", "y", "raw_text").join(vec, "email_id", "left")
    return PublishedScorer(spark, folder, keep=("email_id", "y"))(arriving)
