"""The three scoring agents and the stacked meta-model, fitted with Spark ML.

Every agent is fitted by a distributed ``Estimator.fit``; the driver receives
only coefficients, scaler statistics (2 numbers per feature) and the bounded
vocabulary. Scoring is a ``transform`` (no collect), so the same fitted agent
scores a static table or a stream.

Logistic regressions reproduce the objective C * sum(log-loss) + |w|^2 / 2 by
``regParam = 1 / (C * n)`` with ``standardization=False``; features are first
standardised with the population standard deviation (a constant feature is
divided by 1), computed in one aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LR_C, LR_MAX_ITER, SEED, SEQ_LEN
from ..session import drop_path, scratch_path

PROB = "p"


def write_meta(path: str, meta: dict) -> None:
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


@contextmanager
def training_rows(df: DataFrame) -> Iterator[DataFrame]:
    """The rows written to the shared scratch folder and read again, for the time of one fit.

    An iterative fit runs a job per iteration whose tasks carry the plan of their
    input: a scan is short, the feature plan is not. A lost executor costs a read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "fit")
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        drop_path(spark, path)


def positive_probability(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col("probability")).getItem(1))


# ---- population-std scaler ----

def raw_vector(cols: list[str]) -> Column:
    """The columns as one vector; a missing value counts as 0."""
    return array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols]))


def _vector_stats(df: DataFrame, cols: list[str], vector: str) -> DataFrame:
    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(vector)).alias("s"))
    n = F.col("s.count")
    both = F.arrays_zip(F.array(*[F.lit(c) for c in cols]).alias("feature"),
                        vector_to_array("s.mean").alias("mean"),
                        # the summary's variance divides by n - 1
                        F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n)).alias("std"))
    return s.select(both.alias("z")).select(F.inline("z"))


def scaler_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature, mean, std)``: one vector summary over all columns, unpivoted."""
    return _vector_stats(df.select(raw_vector(cols).alias("_v")), cols, "_v")


def _collected(stats: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (float(r["mean"]), float(r["std"])) for r in stats.collect()}


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    return _collected(scaler_table(df, cols))


def scaled(raw: str, cols: list[str], stats: dict[str, tuple[float, float]]) -> Column:
    """The raw vector column, less the mean and over the standard deviation (1 for a constant)."""
    mean = F.array(*[F.lit(stats[c][0]) for c in cols])
    std = F.array(*[F.lit(stats[c][1] if stats[c][1] > 0 else 1.0) for c in cols])
    x = F.zip_with(F.zip_with(vector_to_array(raw), mean, lambda v, m: v - m), std, lambda v, d: v / d)
    return array_to_vector(x)


def lr(n_rows: int, C: float = LR_C, max_iter: int = LR_MAX_ITER, features: str = "features") -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol="label", regParam=1.0 / (C * max(n_rows, 1)),
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter)


# ---- linear agents over named numeric columns (lexical, stacked) ----

@dataclass
class LinearAgent:
    cols: list[str]
    scale: bool = True
    C: float = LR_C
    stats: dict = field(default_factory=dict)
    model: PipelineModel | None = None

    def _features(self, raw: str) -> Column:
        return scaled(raw, self.cols, self.stats) if self.scale else F.col(raw)

    def fit(self, df: DataFrame, label: str = "y") -> LinearAgent:
        train = df.select(raw_vector(self.cols).alias("_raw"), F.col(label).cast("double").alias("label"))
        with training_rows(train) as train:
            self.stats = _collected(_vector_stats(train, self.cols, "_raw")) if self.scale \
                else {c: (0.0, 1.0) for c in self.cols}
            x = train.select(self._features("_raw").alias("features"), "label")
            self.model = Pipeline(stages=[lr(train.count(), self.C)]).fit(x)
        return self

    def score(self, df: DataFrame, out: str) -> DataFrame:
        keep = df.columns
        x = df.withColumn("_raw", raw_vector(self.cols)).withColumn("features", self._features("_raw"))
        return positive_probability(self.model.transform(x), out).select(*keep, out)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        write_meta(path, {"cols": self.cols, "scale": self.scale, "C": self.C, "stats": self.stats})

    @classmethod
    def load(cls, spark, path: str) -> LinearAgent:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        a = cls(cols=meta["cols"], scale=meta["scale"], C=meta["C"],
                stats={k: tuple(v) for k, v in meta["stats"].items()})
        a.model = PipelineModel.load(f"{path}/model")
        return a


# ---- semantic agent: linear model over a stored embedding ----

@dataclass
class EmbeddingAgent:
    """P(phishing) from a stored text embedding; rows without one get the fit-set prior."""
    C: float = LR_C
    prior: float = 0.5
    dim: int = 0
    model: PipelineModel | None = None

    def fit(self, df: DataFrame, label: str = "y") -> EmbeddingAgent:
        with training_rows(df.select("embedding", F.col(label).cast("double").alias("label"))) as df:
            with_vec = df.where(F.col("embedding").isNotNull())
            train = with_vec.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label")
            rate = df.agg(F.avg("label").alias("rate")).first()["rate"]
            self.prior = 0.5 if rate is None else float(rate)
            first = with_vec.select(F.size("embedding").alias("d")).first()
            self.dim = int(first["d"]) if first else 0
            # without any embedding every row gets the prior
            self.model = Pipeline(stages=[lr(train.count(), self.C)]).fit(train) if first else None
        return self

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """One pass, no union (so it also runs on a stream): rows without an embedding
        get a zero vector for the model and the prior as their score."""
        keep = df.columns
        if self.model is None:
            return df.withColumn(out, F.lit(self.prior))
        zero = F.array_repeat(F.lit(0.0), self.dim)
        vec = F.coalesce(F.col("embedding").cast("array<double>"), zero)
        x = df.withColumn("features", array_to_vector(vec))
        s = positive_probability(self.model.transform(x), "_p")
        return s.select(*keep, F.when(F.col("embedding").isNull(), F.lit(self.prior)).otherwise(F.col("_p")).alias(out))

    def save(self, path: str) -> None:
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        write_meta(path, {"C": self.C, "prior": self.prior, "dim": self.dim})

    @classmethod
    def load(cls, spark, path: str) -> EmbeddingAgent:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        a = cls(C=meta["C"], prior=meta["prior"], dim=meta["dim"])
        a.model = PipelineModel.load(f"{path}/model") if a.dim else None
        return a


# ---- textual agent: word vectors (bounded vocabulary) + small neural head ----

@dataclass
class SequenceAgent:
    """Word2Vec over the words and word pairs of the first 256 vocabulary ids (mean of their
    vectors) -> MLP(128, 128, 2).

    Input column ``ids``: the fixed-length id sequence (0 = padding, 1 = unknown).
    Ids are turned into word strings, and adjacent ids into one of ``pair_buckets``
    strings by a hash of the ordered pair, so the vocabulary is bounded (at
    most 30,002 words and the buckets) whatever the corpus size, and texts of the same words
    in another order have other vectors.

    The fit sees all rows if ``max_rows`` is None, as in every query; a number is a caller's choice of a
    fit on about so many rows, picked by a hash of the row. Scoring covers all.
    Word2Vec averages one model per training partition and trains each in one task, so their
    number is part of the model: ``partitions``, or as many more as keep a partition
    at about ``task_rows`` rows. It follows from the arguments and the number of rows, never from
    cores or input partitions, and a task's time stops growing with the rows.
    The rows are dealt to that many partitions by the hash and
    sorted, so the fit does not depend on how the input was partitioned. Ids are what is
    stored, moved and kept for the passes of the fit (1 KB a row); words are made of them in each pass. The
    network trains to ``tol`` or for ``max_iter`` L-BFGS iterations.
    """
    dim: int = 128
    hidden: int = 128
    min_count: int = 1
    max_iter: int = 200
    tol: float = 1e-6
    seed: int = SEED
    partitions: int = 4
    pair_buckets: int = 1 << 15
    max_rows: int | None = 200_000
    task_rows: int = 17_000
    model: PipelineModel | None = None

    @staticmethod
    def _ids() -> Column:
        return F.filter(F.slice("ids", 1, SEQ_LEN), lambda i: i != 0)

    def _with_words(self, df: DataFrame) -> DataFrame:
        """Adds ``_words`` of the ids without padding in ``_ids``."""
        n = F.greatest(F.size("_ids") - 1, F.lit(0))
        pairs = F.zip_with(F.slice("_ids", 1, n), F.slice("_ids", 2, n), lambda a, b: F.concat(
            F.lit("p"), F.pmod(F.xxhash64(a, b), F.lit(self.pair_buckets)).cast("string")))
        return df.withColumn("_words", F.concat(
            F.transform("_ids", lambda i: F.concat(F.lit("w"), i.cast("string"))), pairs))

    def _words(self, df: DataFrame) -> DataFrame:
        return self._with_words(df.withColumn("_ids", self._ids())).drop("_ids")

    def _chosen(self, train: DataFrame) -> DataFrame:
        """All rows, or about ``max_rows`` by a hash of the row if there are more; the hash is kept as ``_h``."""
        rows = train.withColumn("_h", F.xxhash64("_words", "label"))
        share = 1 if self.max_rows is None else self.max_rows / max(train.count(), 1)
        return rows if share >= 1 else rows.where(
            F.pmod(F.xxhash64("_h", F.lit(self.seed)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def _partitions(self, n_rows: int) -> int:
        """Training partitions for an input of ``n_rows`` rows, of which at most ``max_rows`` are chosen."""
        rows = n_rows if self.max_rows is None else min(n_rows, self.max_rows)
        return max(self.partitions, -(-rows // self.task_rows))

    def fit(self, df: DataFrame, label: str = "y") -> SequenceAgent:
        train = df.select(self._ids().alias("_ids"), F.col(label).cast("double").alias("label"))
        mlp = MultilayerPerceptronClassifier(layers=[self.dim, self.hidden, 2], maxIter=self.max_iter,
                                             tol=self.tol, seed=self.seed, featuresCol="features", labelCol="label")
        with training_rows(train) as train:
            parts = self._partitions(train.count())
            w2v = Word2Vec(vectorSize=self.dim, minCount=self.min_count, inputCol="_words", outputCol="features",
                           seed=self.seed, maxSentenceLength=2 * SEQ_LEN, numPartitions=parts)
            dealt = self._chosen(self._with_words(train)).select("_ids", "label", "_h").repartition(parts, "_h") \
                        .sortWithinPartitions("_h").drop("_h").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                self.model = Pipeline(stages=[w2v, mlp]).fit(self._with_words(dealt).drop("_ids"))
            finally:
                dealt.unpersist()
        return self

    def score(self, df: DataFrame, out: str) -> DataFrame:
        keep = df.columns
        return positive_probability(self.model.transform(self._words(df)), out).select(*keep, out)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        write_meta(path, {"pair_buckets": self.pair_buckets})

    @classmethod
    def load(cls, spark, path: str) -> SequenceAgent:
        a = cls(**json.loads(spark.read.text(f"{path}/meta").first()[0]))
        a.model = PipelineModel.load(f"{path}/model")
        return a


# ---- surface agent (TF-IDF) ----

@dataclass
class TfidfAgent:
    """TF-IDF (1-2-grams, 8000 terms, smooth idf, L2) -> logistic regression.

    The fit reads the terms twice, for the vocabulary and for the counts, and keeps the counts alone:
    a term array is several times its text, and a cache or a reader of nested columns holds
    thousands of them in memory at once. So let ``terms`` be made in the row from stored texts.
    """
    C: float = LR_C
    features: PipelineModel | None = None
    model: PipelineModel | None = None

    def fit(self, terms: DataFrame, label: str = "y") -> TfidfAgent:
        from .tfidf import fit_term_counter, fit_tfidf_weights
        terms = terms.select("terms", F.col(label).cast("double").alias("label"))
        counter = fit_term_counter(terms, "terms", "_tf")
        with training_rows(counter.transform(terms).select("_tf", "label")) as counted:
            weights = fit_tfidf_weights(counted, "_tf", "features")
            x = weights.transform(counted).select("features", "label")
            self.model = Pipeline(stages=[lr(counted.count(), self.C)]).fit(x)
        self.features = PipelineModel(stages=[counter, *weights.stages])
        return self

    def score(self, terms: DataFrame, out: str) -> DataFrame:
        keep = terms.columns
        x = self.features.transform(terms)
        return positive_probability(self.model.transform(x), out).select(*keep, out)

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        self.model.write().overwrite().save(f"{path}/model")
        write_meta(path, {"C": self.C})

    @classmethod
    def load(cls, spark, path: str) -> TfidfAgent:
        a = cls(C=json.loads(spark.read.text(f"{path}/meta").first()[0])["C"])
        a.features = PipelineModel.load(f"{path}/features")
        a.model = PipelineModel.load(f"{path}/model")
        return a


# ---- stacked agent: meta model over the semantic, surface and lexical scores ----

@dataclass
class StackedAgent:
    """Semantic, surface (TF-IDF) and lexical agents under one logistic regression.

    Rows carry ``embedding``, ``terms`` and the lexical feature columns; the
    lexical agent comes fitted (its training rows are URLs, not emails). Scoring
    adds columns to the row, so there is no join.
    """
    lexical: LinearAgent
    semantic: EmbeddingAgent = field(default_factory=EmbeddingAgent)
    surface: TfidfAgent = field(default_factory=TfidfAgent)
    meta: LinearAgent | None = None

    def agent_scores(self, df: DataFrame) -> DataFrame:
        s = self.semantic.score(df, "p_semantic")
        s = self.surface.score(s, "p_surface")
        return self.lexical.score(s, "p_lexical")

    def fit(self, df: DataFrame, label: str = "y") -> StackedAgent:
        self.semantic.fit(df, label)
        self.surface.fit(df, label)
        self.meta = LinearAgent(["p_semantic", "p_surface", "p_lexical"], scale=False).fit(self.agent_scores(df), label)
        return self

    def score(self, df: DataFrame, out: str = "risk_score") -> DataFrame:
        return self.meta.score(self.agent_scores(df), out).select(*df.columns, out)

    def save(self, path: str) -> None:
        for name in ("semantic", "surface", "lexical", "meta"):
            getattr(self, name).save(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> StackedAgent:
        return cls(lexical=LinearAgent.load(spark, f"{path}/lexical"),
                   semantic=EmbeddingAgent.load(spark, f"{path}/semantic"),
                   surface=TfidfAgent.load(spark, f"{path}/surface"),
                   meta=LinearAgent.load(spark, f"{path}/meta"))


# ---- semantic agent with a caller-supplied text encoder ----

def encoder_scores(df: DataFrame, text_col: str, make_predict_fn, out: str = "p_semantic",
                   batch_size: int = 32) -> DataFrame:
    """P(phishing) from a pre-trained encoder with a 2-class head, in Arrow batches of 32.

    ``make_predict_fn`` is called once per Python worker and returns a function
    ``numpy array of texts -> numpy array of P(phishing)`` (e.g. a tokenizer plus
    an ONNX/transformer model truncating at 512 tokens). Loading happens on the
    executors, never on the driver.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType
    udf = predict_batch_udf(make_predict_fn, return_type=DoubleType(), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))
