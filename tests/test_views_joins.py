from pyspark.sql import functions as F

from hookline.functions.text import extract_urls
from hookline.operators.joins import join_bounded
from hookline.sources.tables import emails, mail, urls

SF001 = "/root/testdata/sf0.001"


def test_emails_view_checksums(spark):
    e = emails(spark, SF001)
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.sum(F.length("raw_text")).alias("chars"),
              F.sum(F.size(extract_urls(F.col("raw_text")))).alias("urls")).first()
    assert (r["n"], r["pos"], r["chars"], r["urls"]) == (87, 11, 261263, 89)
    assert mail(spark, SF001).count() == 200           # every document becomes an email


def test_urls_view_labels(spark):
    u = urls(spark, "/root/testdata/sf0.1")
    r = u.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    assert (r["n"], r["pos"]) == (2500, 916)


def test_join_bounded_broadcasts_only_below_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).withColumnRenamed("id", "k")
        small = spark.range(10).withColumnRenamed("id", "k")
        plan_small = join_bounded(big, small, "k", max_rows=10)._jdf.queryExecution().executedPlan().toString()
        plan_big = join_bounded(big, small, "k", max_rows=5)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan_small
        assert "BroadcastHashJoin" not in plan_big
        assert join_bounded(big, small, "k", max_rows=5).count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
