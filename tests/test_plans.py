"""Plan-shape checks for the scale properties the design relies on."""

from pyspark.sql import functions as F

from hookline.functions.urls import FEATURES_54
from hookline.operators.email_urls import email_url_features_exploded, email_url_features_inrow
from hookline.operators.folds import stratified_folds

SF01 = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_inrow_url_aggregation_has_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(
        F.col("doc_id").alias("email_id"), F.lit(0).alias("y"), F.col("text").alias("raw_text"))
    assert "Exchange" not in plan(email_url_features_inrow(docs, FEATURES_54))
    assert "Exchange" in plan(email_url_features_exploded(docs, FEATURES_54))   # the alternative shuffles


def test_fold_rank_never_uses_a_single_partition(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select(F.col("doc_id").alias("email_id"), F.col("toxic").alias("y"))
    p = plan(stratified_folds(labels))
    assert "SinglePartition" not in p
    assert "hashpartitioning(y" in p and "_b" in p       # main rows shuffle on (class, hash bucket)


def test_parquet_scans_are_pruned(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    p = plan(docs.where(F.col("doc_id") < 10).select("doc_id", "text"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p or "struct<doc_id:bigint,text:string>" in p
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in p
