"""Word vocabulary (frequency top-k), token ids and fixed-length id sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.constants import PAD_ID, SEQ_LEN, UNK_ID, VOCAB_MAX, VOCAB_MIN_FREQ


def token_freq(tokens: DataFrame, key: str, col: str = "tokens") -> DataFrame:
    """``(token, freq)`` over all token arrays; partial aggregation keeps hot words cheap."""
    return tokens.select(F.explode(col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def fold_token_freq(tokens: DataFrame, outside: dict[int, Column], col: str = "tokens") -> DataFrame:
    """``(token, freq_<t>, ...)``: word counts of every fold's fit rows from one pass.

    ``outside[t]`` tells whether a row is not a fit row of fold t (its test and calibration
    rows). Counts are additive, so a fold's are those of all rows less those of the rows
    outside it; each token moves once, with its total and k small counts, whatever k is.
    """
    rows = tokens.select(F.explode(col).alias("token"), *[c.cast("int").alias(f"_o{t}") for t, c in outside.items()])
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_o{t}").alias(f"_o{t}") for t in outside])
    return counts.select("token", *[(F.col("_n") - F.col(f"_o{t}")).alias(f"freq_{t}") for t in outside])


def fold_vocab(freq: DataFrame, fold: int) -> DataFrame:
    """The id vocabulary of one fold from ``fold_token_freq``."""
    own = freq.select("token", F.col(f"freq_{fold}").alias("freq")).where("freq > 0")
    return vocab_ids(top_vocab(own))


def text_token_freq(df: DataFrame, text: str) -> DataFrame:
    """``(token, freq)`` of the cleaned tokens of a text column.

    Explodes the plain split and filters rows (all whole-stage codegen) instead
    of exploding the lambda-filtered array, which the generator re-evaluates.
    """
    from ..functions.text import keep_token, raw_clean_parts
    ex = df.select(F.explode(raw_clean_parts(F.col(text))).alias("token"))
    return ex.where(keep_token(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def top_vocab(freq: DataFrame, max_size: int = VOCAB_MAX, min_freq: int = VOCAB_MIN_FREQ) -> DataFrame:
    """The ``max_size`` most frequent tokens (ties by token), then those with freq >= min_freq.

    ``orderBy(...).limit(k)`` plans as a per-partition top-k plus a final merge
    (TakeOrderedAndProject), so only k rows per partition move.
    """
    top = freq.orderBy(F.col("freq").desc(), F.col("token")).limit(max_size)
    return top.where(F.col("freq") >= min_freq)


def vocab_ids(vocab: DataFrame) -> DataFrame:
    """Ids 2.. by frequency rank (0 = padding, 1 = unknown).

    The window has no partition key on purpose: its input is the top-k table,
    at most ``VOCAB_MAX`` rows by construction.
    """
    w = Window.orderBy(F.col("freq").desc(), F.col("token"))
    return vocab.select("token", "freq", (F.row_number().over(w) + 1).cast("int").alias("token_id"))


def pad_to(ids: Column, length: int = SEQ_LEN, pad=PAD_ID) -> Column:
    """First ``length`` entries, right-padded with ``pad``."""
    head = F.slice(ids, 1, length)
    return F.concat(head, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(head))))


def lookup_counts(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Per row: cleaned tokens found in / missing from a ``vocab_ids`` vocabulary (explode +
    broadcast join + regroup; rows without a token are left out).

    The vocabulary has at most ``VOCAB_MAX`` rows by construction. The regroup is
    a ``groupBy(key)`` of counts, combined map-side, so one row per key per
    partition crosses the shuffle.
    """
    from ..functions.text import keep_token, raw_clean_parts
    ex = df.select(key, F.explode(raw_clean_parts(F.col(text))).alias("token")).where(keep_token(F.col("token")))
    j = ex.join(F.broadcast(vocab.select("token", "token_id")), "token", "left")
    return j.groupBy(key).agg(F.count("token_id").alias("n_known"),
                              F.sum(F.when(F.col("token_id").isNull(), 1).otherwise(0)).alias("n_unknown"))


def attach_sequences(df: DataFrame, vocab: DataFrame, col: str = "tokens", length: int = SEQ_LEN,
                     out: str = "ids") -> DataFrame:
    """All columns of ``df`` and the fixed-length id array of ``col`` (unknown -> 1, padding 0).

    No shuffle, join or state, so it also runs on a stream: the vocabulary (at
    most ``VOCAB_MAX`` rows, checked) goes to the tasks and whole Arrow batches
    are looked up at once. Only the first ``length`` tokens of a row reach Python, so a
    batch is bounded whatever the texts' lengths; the other columns stay in the JVM.
    """
    rows = vocab.select("token", "token_id").limit(VOCAB_MAX + 1).collect()   # at most bound + 1 rows
    if len(rows) > VOCAB_MAX:
        raise ValueError(f"vocabulary exceeds the broadcast bound {VOCAB_MAX}")
    words = pa.array([r["token"] for r in rows], pa.string())
    numbers = np.array([r["token_id"] for r in rows] + [UNK_ID], np.int32)

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(lists: pa.Array) -> pa.Array:
        at = pc.index_in(lists.flatten().cast(pa.string()), value_set=words).fill_null(len(words)).to_numpy(
            zero_copy_only=False)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.full((len(sizes), length), PAD_ID, np.int32)
        ids[rows, places] = numbers[at]
        return pa.ListArray.from_arrays(np.arange(0, length * len(sizes) + 1, length, dtype=np.int32), ids.reshape(-1))
    return df.withColumn(out, encode(F.slice(col, 1, length)))


def encode_sequences(tokens: DataFrame, key: str, vocab: DataFrame, col: str = "tokens",
                     length: int = SEQ_LEN, out: str = "ids") -> DataFrame:
    """(key, fixed-length id array) per row."""
    return attach_sequences(tokens.select(key, col), vocab, col, length, out).select(key, out)
