"""The driver's parquet tables and the mail views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_bounded

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Pages that donate the second ("WWW.") link of the two-link emails: ids 0..49.
SECOND_LINK_PAGES = 50


def mail(spark: SparkSession, sf_dir: str, labelled_only: bool = False) -> DataFrame:
    """Every document turned into an email, label ``y`` where one exists.

    A third of the emails get no URL, a third one URL (page ``doc_id div 4``),
    a third two (the second from page ``doc_id % 50``, prefixed with ``WWW.``).

    Plan: the per-document page is re-keyed to ``doc_id`` by expanding each page
    to its four documents, so documents, labels and first-link pages all join
    on ``doc_id`` -- the large text table is shuffled exactly once. The
    second-link pages are a fixed set of 50 ids, broadcast after a size check.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # page p serves documents 4p .. 4p+3 (ids are non-negative)
    first = pages.select(F.explode(F.sequence(F.col("page_id") * 4, F.col("page_id") * 4 + 3)).alias("doc_id"),
                         F.col("url").alias("url1"))
    second = pages.where(F.col("page_id").between(0, SECOND_LINK_PAGES - 1)) \
                  .select(F.col("page_id").alias("page2"), F.col("url").alias("url2"))
    d = docs.join(first, "doc_id", "inner").join(labels, "doc_id", "inner" if labelled_only else "left")
    d = join_bounded(d.withColumn("page2", F.col("doc_id") % SECOND_LINK_PAGES), second, "page2",
                     how="inner", max_rows=10 * SECOND_LINK_PAGES)
    return d.select(
        F.col("doc_id").alias("email_id"), "source", "y",
        compose_mail_text(F.col("doc_id"), F.col("text"), F.col("url1"), F.col("url2")).alias("raw_text"))


def compose_mail_text(doc_id: Column, text: Column, url1: Column, url2: Column) -> Column:
    r = doc_id % 3
    return (F.when(r == 0, text)
             .when(r == 1, F.concat(text, F.lit(" "), url1))
             .otherwise(F.concat(text, F.lit(" "), url1, F.lit(" WWW."), url2)))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled emails ``(email_id, source, y, raw_text)``."""
    return mail(spark, sf_dir, labelled_only=True)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URL table ``(url_id, url, y)``; the label follows the scheme, 10% flipped."""
    pages = table(spark, sf_dir, "pages")
    flip = (F.col("page_id") % 10) == 0
    y = F.when(F.col("url").like("http://%") != flip, 1).otherwise(0)
    return pages.select(F.col("page_id").alias("url_id"), "url", y.alias("y"))


def agent_score(tag: str, key: Column, y: Column) -> Column:
    """Deterministic stand-in probability of an agent: hash-uniform * 0.7 + 0.3 * label."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(tag), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.least(F.lit(1.0), u * 0.7 + 0.3 * y)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(email_id, y, p_semantic, p_textual, p_lexical)`` with hash-derived scores."""
    lab = table(spark, sf_dir, "labels")
    k, y = F.col("doc_id"), F.col("toxic")
    return lab.select(k.alias("email_id"), y.alias("y"),
                      agent_score("sem", k, y).alias("p_semantic"),
                      agent_score("txt", k, y).alias("p_textual"),
                      agent_score("lex", k, y).alias("p_lexical"))
