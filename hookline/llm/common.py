"""Helpers shared by the training-data operators: materialised steps, joins on
skewed keys, and numpy views of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookline.session import scratch_path

#: A key held by more than one row in HOT_SHARE is hot; there are fewer than
#: HOT_SHARE such keys whatever the input, so their table may be broadcast.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns_of(df: DataFrame, want: dict[str, str]) -> DataFrame:
    """The wanted columns, cast to their types; a missing one is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c)
                       for c, t in want.items()])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read again: lineage ends here, and
    a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Column that numbers the rows of a written table; no table should bring its own.
ROW = "_llm_row"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows written with a number each, so that decisions on rows can be joined back."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def join_skewed(big: DataFrame, small: DataFrame, key: str, count: str, total: int,
                spread: str, how: str = "left") -> DataFrame:
    """Join ``big`` to ``small`` (one row per key, ``count`` = rows of the key in big).

    Keys above ``total / HOT_SHARE`` rows are broadcast (fewer than HOT_SHARE of
    them) and their rows are dealt out by ``spread`` instead of the key; all
    other keys are small and take the ordinary shuffle join. Both are dealt by a
    hash, as a key may be of any type, and the keys themselves are compared beside it.
    """
    values = [c for c in small.columns if c != key]
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = small.where(is_hot).select(F.col(key).alias("_hk"),
                                     F.struct(*values).alias("_hot"))
    cold = small.where(~is_hot).select(F.col(key).alias("_ck"), F.struct(*values).alias("_cold"))
    x = big.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    x = x.withColumn("_sh", F.when(F.col("_hk").isNull(), F.xxhash64(key))
                     .otherwise(F.xxhash64(F.col(spread))))
    x = x.join(cold, (F.col("_sh") == F.xxhash64("_ck")) & (F.col(key) == F.col("_ck")) & F.col("_hk").isNull(), "left")
    got = F.coalesce("_hot", "_cold")
    out = x.select(*[F.col(f"`{c}`") for c in big.columns],
                   *[got[v].alias(v) for v in values], got.isNotNull().alias("_got"))
    if how == "inner":
        out = out.where("_got")
    return out.drop("_got")


# --- numpy views of text -------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, 1 << 20)
        for i, p in enumerate((_P, _PINV)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _pow[i] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and the n + 1 row offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Row slices of about max_bytes of text (a longer row stands alone), so that
    arrays of several words a byte stay small."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << np.uint8(5))


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums; ``span_hash`` turns two of them into a substring's hash."""
    n = len(buf)
    pw, _ = _powers(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[:n], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(h))
    return mix((h[end] - h[start]) * inv[start])


def word_spans(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not separators."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = sep[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    left = first[:n].copy()
    left[1:] |= gap[:-1]
    left[0] = True
    right = first[1:].copy()
    right[:-1] |= gap[1:]
    right[-1] = True
    start = np.flatnonzero(left & ~gap)
    end = np.flatnonzero(right & ~gap) + 1
    row = np.searchsorted(off, start, "right") - 1
    return start, end, row


def shingle_hashes(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of a row, and its row; a row with fewer
    words gives one hash of its whole sequence."""
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(row)
    acc = np.full(n, np.uint64(k), np.uint64)
    size = np.minimum(counts[row], k)
    acc = size.astype(np.uint64)
    first = np.searchsorted(row, row)  # place of the row's first word
    place = np.arange(n) - first
    for j in range(k):
        use = np.flatnonzero(j < size) if j else np.arange(n)
        nxt = use + j
        ok = nxt < n
        use, nxt = use[ok], nxt[ok]
        acc[use] = mix(acc[use] * _P + word[nxt])
    keep = place <= counts[row] - size
    return acc[keep], row[keep]
