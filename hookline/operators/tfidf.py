"""TF-IDF over 1-2-gram terms: relational long form and the Spark ML vector form.

Weights follow the smooth-idf convention idf = ln((1 + n) / (1 + df)) + 1 and
an L2 norm per document. Spark ML's ``IDF`` computes ln((n + 1) / (df + 1))
without the +1, so the vector form rescales term counts by (idf + 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.constants import TFIDF_MAX_TERMS
from ..functions.text import with_bigrams, word_tokens
from .heavy import token_pieces, with_pairs


def doc_terms(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``(key, *keep, terms)``: lower-cased word tokens followed by adjacent pairs (array form)."""
    toks = df.select(key, *keep, word_tokens(text).alias("_t"))
    return toks.select(key, *keep, with_bigrams(F.col("_t")).alias("terms"))


def corpus_terms(df: DataFrame, text: str) -> DataFrame:
    """``(term, n, df)``: occurrences and documents of every unigram and adjacent pair, and one
    row with a null term whose ``df`` is the number of documents.

    A document is one row, so its terms are counted in the row: they are sorted, and the
    last of each run of equal terms is marked. Occurrences and marks are summed
    by term in the task before anything moves; no exchange is keyed by document.
    Terms are structs (word, next word or null) until then: no lambda, so the
    generator's input is computed once per row.
    """
    t, n = F.col("_t"), F.size("_t")
    none = F.array().cast("array<string>")
    pairs = F.arrays_zip(F.slice(t, 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                         F.slice(t, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    words = F.arrays_zip(t.alias("a"), none.alias("b"))
    document = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    kind = "array<struct<a:string,b:string>>"
    rows = df.select(F.coalesce(word_tokens(text), none).alias("_t"))
    sorted_ = rows.select(F.sort_array(F.concat(document.cast(kind), words.cast(kind), pairs.cast(kind))).alias("_s"))
    runs = sorted_.select(F.inline(F.arrays_zip(F.col("_s").alias("x"), F.slice("_s", 2, F.size("_s")).alias("next"))))
    term = F.when(F.col("x.b").isNull(), F.col("x.a")).otherwise(F.concat(F.col("x.a"), F.lit(" "), F.col("x.b")))
    last = F.col("next").isNull() | ~F.col("next").eqNullSafe(F.col("x"))
    return runs.select(term.alias("term"), last.cast("long").alias("_last")) \
               .groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("_last").alias("df"))


def top_terms(corpus: DataFrame, k: int = TFIDF_MAX_TERMS) -> DataFrame:
    """The k terms with the highest corpus count (ties by term), with their document frequency."""
    return corpus.where(F.col("term").isNotNull()).orderBy(F.col("n").desc(), F.col("term")).limit(k)


def with_idf(top: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``idf`` = ln((1 + documents) / (1 + df)) + 1; the document count is the corpus's null row."""
    docs = corpus.where(F.col("term").isNull()).select(F.col("df").alias("_docs"))   # one row
    return top.join(F.broadcast(docs)).withColumn("idf", F.log((F.lit(1.0) + F.col("_docs")) / (F.col("df") + 1.0)) + 1.0) \
              .drop("_docs")


def tfidf_long(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """``(key, term, weight)``: tf * idf, L2-normalised per document, for the terms of ``vocab`` (term, idf).

    The vocabulary has at most TFIDF_MAX_TERMS rows (checked) and goes to the tasks; a
    document is counted, weighted and normalised within its row, so nothing is shuffled.
    """
    rows = vocab.select("term", "idf").limit(TFIDF_MAX_TERMS + 1).collect()   # at most bound + 1 rows
    if len(rows) > TFIDF_MAX_TERMS:
        raise ValueError(f"vocabulary exceeds the bound {TFIDF_MAX_TERMS}")
    terms = pa.array([r["term"] for r in rows], pa.string())
    idf = np.array([r["idf"] for r in rows], np.float64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, flat, row in token_pieces(batch, "_t"):
                flat, of = with_pairs(flat, row)
                ids = pc.index_in(flat, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
                code, tf = np.unique((of * np.int64(len(idf) + 1) + ids)[ids >= 0], return_counts=True)
                of, ids = code // (len(idf) + 1), code % (len(idf) + 1)
                w = tf * idf[ids]
                norm = np.sqrt(np.bincount(of - at, w * w, to - at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(of)), terms.take(pa.array(ids)), pa.array(w / norm[of - at])],
                    [key, "term", "weight"])
    t = df.select(key, word_tokens(text).alias("_t"))
    schema = StructType([df.schema[key], StructField("term", StringType()), StructField("weight", DoubleType())])
    return t.mapInArrow(weigh, schema)


def fit_term_counter(terms: DataFrame, col: str = "terms", out: str = "_tf",
                     k: int = TFIDF_MAX_TERMS) -> CountVectorizerModel:
    """Counts of the k most frequent terms, with ties by term, as in ``top_terms``;
    CountVectorizer's own fit takes any of the tied terms."""
    corpus = terms.select(F.explode(col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    vocab = [r["term"] for r in corpus.orderBy(F.col("n").desc(), F.col("term")).limit(k).collect()]
    return CountVectorizerModel.from_vocabulary(vocab, inputCol=col, outputCol=out)


def fit_tfidf_weights(counted: DataFrame, tf: str = "_tf", out: str = "tfidf") -> PipelineModel:
    """Stages that turn term counts into (idf + 1) * counts, L2-normalised."""
    idf = IDF(inputCol=tf, outputCol="_ignored").fit(counted)
    scale = ElementwiseProduct(inputCol=tf, outputCol="_tfidf",
                               scalingVec=Vectors.dense([x + 1.0 for x in idf.idf.toArray()]))
    return PipelineModel(stages=[scale, Normalizer(inputCol="_tfidf", outputCol=out, p=2.0)])


def fit_tfidf_vectors(terms: DataFrame, col: str = "terms", out: str = "tfidf", k: int = TFIDF_MAX_TERMS) -> PipelineModel:
    """Fitted feature stages: term counts -> (idf + 1) rescale -> L2 normaliser."""
    counter = fit_term_counter(terms, col, "_tf", k)
    return PipelineModel(stages=[counter, *fit_tfidf_weights(counter.transform(terms), "_tf", out).stages])
