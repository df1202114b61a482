"""Catalog entries: vocabulary, id sequences, term statistics and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import SEQ_LEN, TFIDF_MAX_TERMS, VOCAB_MAX, VOCAB_MIN_FREQ
from ..functions.text import clean_tokens, word_tokens
from ..operators.heavy import top_counts
from ..operators.tfidf import corpus_terms, tfidf_long, top_terms, with_idf
from ..operators.vocab import encode_sequences, lookup_counts, pad_to, text_token_freq, top_vocab, vocab_ids
from ..session import scratch_path
from ..sources.tables import emails, table
from . import oracle_sql as O
from .registry import register

TOKS_CTE = f"toks AS (SELECT doc_id, {O.clean_tokens_sql('text')} AS tokens FROM documents)"
FREQ_CTE = TOKS_CTE + ",\nfreq AS (SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token)"
VOCAB_CTE = FREQ_CTE + f""",
top AS (SELECT * FROM freq ORDER BY freq DESC, token LIMIT {VOCAB_MAX}),
vocab AS (SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS INTEGER) AS token_id
          FROM top WHERE freq >= {VOCAB_MIN_FREQ})"""


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean_tokens(F.col("text")).alias("tokens"))


def _freq(spark, sf_dir):
    return text_token_freq(table(spark, sf_dir, "documents"), "text")


def _vocab(spark, sf_dir):
    return vocab_ids(top_vocab(_freq(spark, sf_dir)))


@register("agg_token_freq", O.with_ctes(FREQ_CTE) + "SELECT token, CAST(freq AS BIGINT) AS freq FROM freq")
def agg_token_freq(spark, sf_dir):
    return _freq(spark, sf_dir).select("token", F.col("freq").cast("bigint").alias("freq"))


@register("topk_vocab", O.with_ctes(VOCAB_CTE) + "SELECT token, CAST(freq AS BIGINT) AS freq FROM vocab")
def topk_vocab(spark, sf_dir):
    top = top_counts(_tokens(spark, sf_dir), "tokens", VOCAB_MAX)
    return top.where(F.col("n") >= VOCAB_MIN_FREQ).select(F.col("term").alias("token"), F.col("n").cast("bigint").alias("freq"))


@register("win_vocab_ids", O.with_ctes(VOCAB_CTE) + "SELECT token, token_id FROM vocab")
def win_vocab_ids(spark, sf_dir):
    return _vocab(spark, sf_dir).select("token", "token_id")


@register("agg_vocab_size", O.with_ctes(VOCAB_CTE) + "SELECT CAST(count(*) + 2 AS BIGINT) AS vocab_size FROM vocab")
def agg_vocab_size(spark, sf_dir):
    return _vocab(spark, sf_dir).agg((F.count(F.lit(1)) + 2).cast("bigint").alias("vocab_size"))


@register("join_vocab_lookup", O.with_ctes(VOCAB_CTE) + """,
ex AS (SELECT doc_id, unnest(tokens) AS token FROM toks),
c AS (SELECT ex.doc_id, count(v.token_id) AS n_known, sum(CASE WHEN v.token_id IS NULL THEN 1 ELSE 0 END) AS n_unknown
      FROM ex LEFT JOIN vocab v ON ex.token = v.token GROUP BY ex.doc_id)
SELECT c.doc_id, CAST(n_known AS BIGINT) AS n_known, CAST(n_unknown AS BIGINT) AS n_unknown FROM c""")
def join_vocab_lookup(spark, sf_dir):
    c = lookup_counts(table(spark, sf_dir, "documents"), "doc_id", "text", _vocab(spark, sf_dir))
    return c.select("doc_id", F.col("n_known").cast("bigint").alias("n_known"), F.col("n_unknown").cast("bigint").alias("n_unknown"))


@register("txt_encode_ids", O.with_ctes(VOCAB_CTE) + f""",
ex AS (SELECT doc_id, generate_subscripts(tokens[1:{SEQ_LEN}], 1) AS pos, unnest(tokens[1:{SEQ_LEN}]) AS token FROM toks),
ids AS (SELECT ex.doc_id, list(coalesce(v.token_id, 1) ORDER BY pos) AS ids FROM ex LEFT JOIN vocab v ON ex.token = v.token GROUP BY ex.doc_id),
full_ids AS (SELECT t.doc_id, coalesce(ids.ids, []) AS ids FROM toks t LEFT JOIN ids ON t.doc_id = ids.doc_id)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range({SEQ_LEN} - len(ids)), lambda x: 0)), ',') AS ids FROM full_ids""")
def txt_encode_ids(spark, sf_dir):
    enc = encode_sequences(_tokens(spark, sf_dir), "doc_id", _vocab(spark, sf_dir))
    return enc.select("doc_id", F.array_join("ids", ",").alias("ids"))


@register("limit_sequence", O.with_ctes(TOKS_CTE) + f"""
SELECT doc_id, array_to_string(tokens[1:{SEQ_LEN}], ' ') AS head, CAST(greatest(0, {SEQ_LEN} - len(tokens)) AS BIGINT) AS n_pad FROM toks""")
def limit_sequence(spark, sf_dir):
    """First 256 tokens, and how many padding slots the fixed-length form adds."""
    t = _tokens(spark, sf_dir).select("doc_id", "tokens", pad_to(F.col("tokens"), SEQ_LEN, "").alias("seq"))
    return t.select("doc_id", F.array_join(F.slice("tokens", 1, SEQ_LEN), " ").alias("head"),
                    F.size(F.filter("seq", lambda x: x == "")).cast("bigint").alias("n_pad"))


# ---- TF-IDF (surface agent features) over the labelled emails ----

TERMS_CTE = O.EMAILS_CTE + f""",
wt AS (SELECT email_id, {O.word_tokens_sql('raw_text')} AS t FROM emails),
terms AS (SELECT email_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM wt),
tf AS (SELECT email_id, term, count(*) AS tf FROM (SELECT email_id, unnest(terms) AS term FROM terms) GROUP BY email_id, term),
corpus AS (SELECT term, sum(tf) AS n, count(*) AS df FROM tf GROUP BY term),
topt AS (SELECT * FROM corpus ORDER BY n DESC, term LIMIT {TFIDF_MAX_TERMS}),
nd AS (SELECT count(*) AS n_docs FROM emails)"""


def _corpus(spark, sf_dir):
    return corpus_terms(emails(spark, sf_dir), "raw_text")


@register("agg_tf", O.with_ctes(TERMS_CTE) + "SELECT term, CAST(n AS BIGINT) AS n, CAST(df AS BIGINT) AS df FROM corpus")
def agg_tf(spark, sf_dir):
    return _corpus(spark, sf_dir).where(F.col("term").isNotNull()).select(
        "term", F.col("n").cast("bigint").alias("n"), F.col("df").cast("bigint").alias("df"))


@register("topk_tfidf_terms", O.with_ctes(TERMS_CTE) + "SELECT term, CAST(n AS BIGINT) AS n FROM topt")
def topk_tfidf_terms(spark, sf_dir):
    words = emails(spark, sf_dir).select(word_tokens("raw_text").alias("t"))
    return top_counts(words, "t", TFIDF_MAX_TERMS, pairs=True).select("term", F.col("n").cast("bigint").alias("n"))


@register("agg_df_idf", O.with_ctes(TERMS_CTE) + """
SELECT term, CAST(df AS BIGINT) AS df, round(ln((1.0 + n_docs) / (1.0 + df)) + 1.0, 6) AS idf FROM topt, nd""")
def agg_df_idf(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return with_idf(top_terms(corpus), corpus).select("term", F.col("df").cast("bigint").alias("df"), F.round("idf", 6).alias("idf"))


@register("ml_surface_tfidf", O.with_ctes(TERMS_CTE) + """,
w AS (SELECT tf.email_id, tf.term, tf.tf * (ln((1.0 + n_docs) / (1.0 + topt.df)) + 1.0) AS w FROM tf JOIN topt ON tf.term = topt.term, nd),
nrm AS (SELECT email_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY email_id)
SELECT w.email_id, w.term, round(w.w / nrm.norm, 6) AS weight FROM w JOIN nrm ON w.email_id = nrm.email_id""")
def ml_surface_tfidf(spark, sf_dir):
    e = emails(spark, sf_dir)
    corpus = corpus_terms(e, "raw_text")
    path = scratch_path(spark, "tfidf-terms")
    with_idf(top_terms(corpus), corpus).write.parquet(path)   # at most 8,000 rows
    out = tfidf_long(e, "email_id", "raw_text", spark.read.parquet(path))
    return out.select("email_id", "term", F.round("weight", 6).alias("weight"))
