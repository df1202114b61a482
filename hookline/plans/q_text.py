"""Catalog entries: text jobs over the documents and the mail view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, extract_urls, with_bigrams, word_tokens
from ..operators.email_urls import exploded_urls
from ..sources.tables import mail, table
from . import oracle_sql as O
from .registry import register


@register("txt_clean_corpus", O.with_ctes("d AS (SELECT doc_id, " + O.clean_text_sql("text") + " AS clean_text FROM documents)") + """
SELECT doc_id, clean_text, CAST(length(clean_text) AS BIGINT) AS clean_len FROM d""")
def txt_clean_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", clean_text("text").alias("clean_text"))
    return d.select("doc_id", "clean_text", F.length("clean_text").cast("bigint").alias("clean_len"))


@register("txt_extract_urls", O.with_ctes(O.MAIL_CTE, "u AS (SELECT email_id, " + O.extract_urls_sql("raw_text") + " AS urls FROM mail)") + """
SELECT email_id, CAST(generate_subscripts(urls, 1) - 1 AS BIGINT) AS pos, unnest(urls) AS url FROM u""")
def txt_extract_urls(spark, sf_dir):
    return exploded_urls(mail(spark, sf_dir)).select("email_id", F.col("pos").cast("bigint").alias("pos"), "url")


@register("txt_word_tokens", O.with_ctes("t AS (SELECT doc_id, " + O.word_tokens_sql("text") + " AS toks FROM documents)") + """
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM t""")
def txt_word_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", word_tokens("text").alias("toks"))
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@register("txt_bigrams", O.with_ctes("t AS (SELECT doc_id, " + O.word_tokens_sql("text") + " AS toks FROM documents)") + """
SELECT doc_id, CAST(len(toks) + greatest(len(toks) - 1, 0) AS BIGINT) AS n_terms,
       array_to_string(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])), '|') AS terms
FROM t""")
def txt_bigrams(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", word_tokens("text").alias("toks"))
    t = t.select("doc_id", with_bigrams(F.col("toks")).alias("terms"))
    return t.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


# ---- stopword removal as a join ----
from ..functions.constants import STOPWORDS  # noqa: E402
from ..functions.text import raw_clean_parts  # noqa: E402
from ..operators.joins import join_bounded  # noqa: E402


@register("join_stopword_anti", f"""SELECT doc_id, CAST(len({O.clean_tokens_sql('text')}) AS BIGINT) AS n_kept FROM documents
WHERE len({O.clean_tokens_sql('text')}) > 0""")
def join_stopword_anti(spark, sf_dir):
    """Stopword removal as a left-anti join of exploded tokens with the (39-row) stopword table."""
    stops = spark.createDataFrame([(w,) for w in STOPWORDS], "token string")
    ex = table(spark, sf_dir, "documents").select("doc_id", F.explode(raw_clean_parts(F.col("text"))).alias("token"))
    kept = join_bounded(ex.where(F.length("token") > 1), stops, "token", how="left_anti", max_rows=len(STOPWORDS))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_kept"))
