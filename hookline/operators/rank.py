"""Global ranks and running sums without a single-partition window.

``Window.orderBy(x)`` with no (or a 2-valued) partition key moves every row to
one task. Here the order is cut into buckets that are contiguous in that order:

1. per (group, bucket) totals -- a table with at most groups x buckets rows;
2. running offsets of those totals -- a window over that small table;
3. offsets joined back (broadcast after a size check);
4. ``Window.partitionBy(group, bucket).orderBy(...)`` for the in-bucket part.

Buckets come either from a uniform hash prefix (md5 ranks) or from approximate
percentiles of the ordering key (scores), so no bucket holds much more than its
share. Rows with equal ordering keys must be collapsed before (ROC does that by
aggregating per distinct score), so a hot value cannot make a hot bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_bounded

# Rows per bucket aimed at when sizing buckets from a row count.
TARGET_BUCKET_ROWS = 2_000_000
MAX_BUCKETS = 1 << 16


def prefix_sums(df: DataFrame, group: list[str], bucket: Column, order: list[Column],
                values: dict[str, Column], totals: bool = False, max_groups: int | None = None) -> DataFrame:
    """Add running sums of ``values`` along ``order`` within each ``group``.

    ``bucket`` must be monotone in ``order`` (bucket b rows all precede bucket b+1
    rows). With ``totals``, also adds ``total_<name>`` = the group's full sum.
    ``max_groups``: a bound on the number of groups known by construction (two
    classes, k folds). The offsets table then has at most max_groups x
    MAX_BUCKETS rows and is broadcast without a counting pass; otherwise its
    size is measured first.
    """
    names = list(values)
    d = df.select("*", bucket.alias("_b"), *[v.alias(f"_v_{n}") for n, v in values.items()])
    per_bucket = d.groupBy(*group, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_bucket.select(
        *group, "_b",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
        *([F.sum(f"_s_{n}").over(whole).alias(f"total_{n}") for n in names] if totals else []))
    if max_groups is not None and max_groups <= 16:   # at most 16 x MAX_BUCKETS short rows
        d = d.join(F.broadcast(offsets), [*group, "_b"], "inner")
    else:
        d = join_bounded(d, offsets, [*group, "_b"], how="inner", max_rows=4 * MAX_BUCKETS)
    running = Window.partitionBy(*group, "_b").orderBy(*order) \
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keep = [c for c in df.columns]
    return d.select(*keep,
                    *[(F.sum(f"_v_{n}").over(running) + F.col(f"_o_{n}")).alias(n) for n in names],
                    *([F.col(f"total_{n}") for n in names] if totals else []))


def hash_order(seed, key: Column) -> tuple[Column, Column]:
    """(60-bit md5 order value, bucket from the first 3 hex digits) of ``seed:key``.

    ``seed`` is a literal or a Column (e.g. a per-fold seed).
    """
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    h = F.md5(F.concat(seed_c.cast("string"), F.lit(":"), key.cast("string")))
    return (F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"),
            F.conv(F.substring(h, 1, 3), 16, 10).cast("int"))


def hash_rank(df: DataFrame, group: list[str], key: str, seed, out: str = "rank",
              totals: bool = False, max_groups: int | None = None) -> DataFrame:
    """1-based rank of rows within ``group`` by md5(seed:key), ties broken by key."""
    h, b = hash_order(seed, F.col(key))
    d = df.withColumn("_h", h)
    r = prefix_sums(d, group, b, [F.col("_h"), F.col(key)], {out: F.lit(1).cast("bigint")}, totals=totals,
                    max_groups=max_groups)
    return r.drop("_h")


def next_in_order(df: DataFrame, group: list[str], bucket: str, order: list[Column],
                  cols: list[str], head_key: Column) -> DataFrame:
    """Add ``next_<c>``: the value of ``c`` on the following row in ``order`` (null on the last).

    In-bucket ``lead`` plus, for each bucket's last row, the first row of the next
    non-empty bucket (from a per-bucket table of at most groups x buckets rows).
    ``head_key`` increases along ``order`` (its minimum marks a bucket's first row).
    """
    first = df.groupBy(*group, bucket).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), head_key).alias("_first"))
    nxt = Window.partitionBy(*group).orderBy(bucket)
    heads = first.select(*group, bucket, F.lead("_first").over(nxt).alias("_next_head"))
    d = join_bounded(df, heads, [*group, bucket], how="inner", max_rows=4 * MAX_BUCKETS)
    w = Window.partitionBy(*group, bucket).orderBy(*order)
    return d.select(*df.columns, *[F.coalesce(F.lead(c).over(w), F.col("_next_head").getField(c)).alias(f"next_{c}")
                                   for c in cols])


def percentile_splits(df: DataFrame, key: str, n_rows: int, accuracy: int = 10_000) -> list[float]:
    """Bucket split points for ``key`` with roughly equal rows per bucket.

    Split points are approximate percentiles of ``key`` (one aggregate job; the
    driver receives at most MAX_BUCKETS numbers). Returns ``[-inf, ..., inf]``.
    """
    k = int(min(MAX_BUCKETS, max(1, math.ceil(n_rows / TARGET_BUCKET_ROWS))))
    if k <= 1:
        return [-math.inf, math.inf]
    probs = [i / k for i in range(1, k)]
    cuts = df.agg(F.percentile_approx(key, probs, accuracy).alias("q")).first()["q"] or []
    return [-math.inf] + sorted(set(float(c) for c in cuts)) + [math.inf]


def with_bucket(df: DataFrame, key: str, splits: list[float], out: str) -> DataFrame:
    """Bucket index of ``key`` by binary search in the JVM (Spark ML ``Bucketizer``)."""
    if len(splits) <= 2:
        return df.withColumn(out, F.lit(0))
    b = Bucketizer(splits=splits, inputCol=key, outputCol=out, handleInvalid="keep").transform(df)
    return b.withColumn(out, F.col(out).cast("int"))
