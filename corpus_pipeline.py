"""Corpus pipeline: five stages that turn ``documents`` into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of documents, whatever they are, and only drop rows:

1. toxicity: rows that the calibrated trees score 0.5 or more go;
2. near_dedup: one row of each group of near duplicates stays (five-word
   shingles, similarity 0.8);
3. decontaminate: rows that contain a benchmark item go;
4. secrets: rows with a secret, or weak parts that complete each other, go;
5. pack: the rest becomes pieces with a sequence and an offset each.

Null texts count as empty: they are scored, link with nothing, contain nothing
and are packed as a separator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hookline.llm import decontaminate, minhash, packing, secrets, toxicity
from hookline.llm.common import table
from hookline.session import drop_path, scratch_path, scratch_scope


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.drop_secrets(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("secrets", stage_secrets),
    ("pack", stage_pack),
]

#: Boosted trees, components of verified links and the rounding of a linear
#: program are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. Of what the stages write only this result stays: a stage's own tables
    go when its output is written, its input when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    read = None
    for name, stage in STAGES:
        with scratch_scope(spark) as scope:
            out = stage(spark, docs, sf_dir)
            path = scratch_path(spark, f"pipeline-{name}")
            out.write.option("compression", "zstd").parquet(path)
            scope.keep(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if read is not None:
            drop_path(spark, read)
        read = path
    return docs
