"""Threshold calibration by search: no row per distinct score, no order over the table.

The threshold is the score at which the true-positive rate is highest while the
false-positive rate stays at or below alpha. Only scores around the place where the rate crosses
alpha matter for it. Rows are counted in BUCKETS equal steps of the score, per group; the
bucket in which the count of negatives crosses is cut into steps again, and so on until it
holds few rows. The points of that bucket and of as many buckets above it as the rule needs
are collapsed by score and looked at exactly:

* L: the last point at or below alpha. The curve keeps its first and last point and every point whose
  increment differs from the next one's (others are collinear); the rule looks at kept points.
* k: L, or the last kept point before it. Between them all increments are those of the point
  after L, so the edge that is needed is the last point with another increment.
* The threshold: the last point up to k that adds a positive (points after it have the
  same true-positive rate at a lower score). It is kept itself: it adds a positive and its successor does not.

Buckets are monotone functions of the score, compared level by level, so a
score's bucket, its order and the counts above it are exact whatever the rounding.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ALPHA
from ..session import drop_path, scratch_path
from .roc import calibrate, roc_points

BUCKETS = 4096
#: A crossing bucket with more rows is cut again, at most MAX_LEVELS times (a double has 52 bits).
FEW_ROWS = 20_000
MAX_LEVELS = 5
#: Points looked at exactly, over all groups; beyond that the whole curve is built.
MAX_POINTS = 500_000

_FIELDS = "tau_cal double, feasible boolean, tpr_at_tau double, fpr_at_tau double"


@dataclass
class _Group:
    key: tuple
    pos: int
    neg: int
    low: float
    high: float
    ceiling: int = 0                                    # negatives allowed
    lows: list[float] = field(default_factory=list)     # range of each level
    highs: list[float] = field(default_factory=list)
    path: list[int] = field(default_factory=list)       # crossing bucket of each level
    above: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # (level, bucket, rows, tp, fp), highest first
    rows: int = 0                                       # in the crossing bucket
    take: int = 0                                       # buckets of ``above`` that are looked at
    result: tuple | None = None


def _bucket(score: Column, low: Column, high: Column) -> Column:
    """0 for the highest scores; never rises with the score."""
    step = F.floor((high - score) / (high - low) * BUCKETS)
    return F.when(high > low, F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), step))).otherwise(0).cast("int")


def _ceiling(neg: int, alpha: float) -> int:
    """The most false positives whose rate is at or below alpha."""
    n = min(neg, int(alpha * neg) + 1)
    while n >= 0 and not n / neg <= alpha:
        n -= 1
    return n


def _with_levels(rows: DataFrame, groups: list[_Group], names: list[str], kinds: str) -> DataFrame:
    """Rows of the groups with their bucket at every level so far (``_b0``, ``_b1``, ...)."""
    levels = len(groups[0].lows)
    spark = rows.sparkSession

    def start(g: _Group) -> tuple[int, int]:
        """The highest bucket that is looked at."""
        if g.take:
            return g.above[-g.take][:2]
        return (len(g.path) - 1, g.path[-1]) if g.path else (0, 0)
    table = [(*g.key, g.lows, g.highs, g.path, start(g)) for g in groups]
    schema = f"{kinds}, _lows array<double>, _highs array<double>, _path array<int>, _start struct<level:int,bucket:int>"
    params = spark.createDataFrame(table, schema)   # one row a group
    j = rows.join(F.broadcast(params), names) if names else rows.join(F.broadcast(params))
    return j.select("*", *[_bucket(F.col("score"), F.col("_lows")[i], F.col("_highs")[i]).alias(f"_b{i}") for i in range(levels)])


def _in_path(upto: int) -> Column:
    cond = F.lit(True)
    for i in range(upto):
        cond = cond & (F.col(f"_b{i}") == F.col("_path")[i])
    return cond


def _beyond(levels: int) -> Column:
    """Whether a row stands below the crossing bucket."""
    cond = F.lit(False)
    for i in reversed(range(levels)):
        cond = (F.col(f"_b{i}") > F.col("_path")[i]) | ((F.col(f"_b{i}") == F.col("_path")[i]) & cond)
    return cond


def _resolve(g: _Group, points: list[tuple[float, int, int]], prune: bool) -> tuple | None:
    """The group's answer from the points (score, tp_d, fp_d) looked at, highest first; None if more are needed."""
    whole = g.take == len(g.above)
    hidden = g.above[:len(g.above) - g.take]
    tp, fp = sum(a[3] for a in hidden), sum(a[4] for a in hidden)
    cum = []
    for _, t, f in points:
        tp, fp = tp + t, fp + f
        cum.append((tp, fp))
    last = max((i for i, (_, f) in enumerate(cum) if f <= g.ceiling), default=-1)
    if last < 0:
        return (g.low, False, 1.0 if g.pos else math.nan, 1.0) if whole else None
    k = last
    if prune and last + 1 < len(points):   # the table's last point is kept
        after = points[last + 1][1:]
        while k >= 0 and points[k][1:] == after:
            k -= 1
        if k < 0:
            if not whole:
                return None
            k = 0   # the first point is kept
    s = k
    while s >= 0 and points[s][1] == 0:
        s -= 1
    if s < 0:
        return (g.low, False, 1.0 if g.pos else math.nan, 1.0) if whole else None
    return points[s][0], True, cum[s][0] / g.pos, cum[s][1] / g.neg


def search_threshold(df: DataFrame, group: list[str] | None = None, score: str = "score", label: str = "y",
                     alpha: float = ALPHA, prune: bool = True) -> DataFrame:
    """``(group..., tau_cal, feasible, tpr_at_tau, fpr_at_tau)``, as ``calibrate`` of the whole curve gives.

    The rows (group, score, label) are written once; then a grouped count for each level and one or
    two looks at the points around the crossing. Groups are few (folds).
    """
    names = list(group or [])
    spark = df.sparkSession
    path = scratch_path(spark, "calibrate")
    slim = df.select(*names, F.col(score).cast("double").alias("score"), F.col(label).cast("bigint").alias("y"))
    try:
        slim.write.parquet(path)
        rows = spark.read.schema(slim.schema).parquet(path)
        kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
        got = _search(rows, names, kinds, alpha, prune)
        if got is None:   # a very long collinear stretch
            pts = roc_points(rows, names, "score", "y", prune=prune)
            got = [tuple(r) for r in calibrate(pts, names, alpha, use_pruned=prune).collect()]
    finally:
        drop_path(spark, path)
    return spark.createDataFrame(got, ", ".join(x for x in (kinds, _FIELDS) if x))


def _search(rows: DataFrame, names: list[str], kinds: str, alpha: float, prune: bool) -> list[tuple] | None:
    whole = rows.groupBy(*names).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"),
                                     F.min("score").alias("low"), F.max("score").alias("high"))
    groups = [_Group(tuple(r[:len(names)]), r["p"], r["n"], r["low"], r["high"]) for r in whole.collect() if r["p"] is not None]
    for g in groups:
        if not g.neg:   # no rate, so nothing is at or below alpha
            g.result = (g.low, False, 1.0 if g.pos else math.nan, math.nan)
        else:
            g.ceiling = _ceiling(g.neg, alpha)
            g.lows, g.highs = [g.low], [g.high]
    open_ = [g for g in groups if g.result is None]
    kinds = kinds or "_all int"
    if not names:
        rows = rows.withColumn("_all", F.lit(0))
        names = ["_all"]
        for g in groups:
            g.key = (0,)
    for level in range(MAX_LEVELS):
        if not open_:
            break
        x = _with_levels(rows, open_, names, kinds).where(_in_path(level))
        hist = x.groupBy(*names, F.col(f"_b{level}").alias("b")).agg(
            F.count(F.lit(1)).alias("c"), F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"),
            F.min("score").alias("low"), F.max("score").alias("high")).collect()   # at most BUCKETS rows a group
        of: dict[tuple, list] = {}
        for r in hist:
            of.setdefault(tuple(r[n] for n in names), []).append(r)
        for g in open_:
            found = sorted(of[g.key], key=lambda r: r["b"])
            fp = sum(a[4] for a in g.above)
            for i, r in enumerate(found):
                fp += r["fp"]
                if fp > g.ceiling or i == len(found) - 1:
                    g.path.append(r["b"])
                    g.rows = r["c"]
                    g.lows.append(r["low"])
                    g.highs.append(r["high"])
                    break
                g.above.append((level, r["b"], r["c"], r["tp"], r["fp"]))
        if all(g.rows <= FEW_ROWS or g.lows[-1] == g.highs[-1] for g in open_):
            break
    for g in open_:   # the range below the crossing bucket is not a level of its own
        g.lows, g.highs = g.lows[:len(g.path)], g.highs[:len(g.path)]
    want = 64
    while open_:
        for g in open_:
            count, g.take = 0, 0
            while g.take < len(g.above) and count < want:
                g.take += 1
                count += g.above[-g.take][2]
        x = _with_levels(rows, open_, names, kinds)
        levels = len(open_[0].path)
        start = F.lit(False)
        for i in range(levels):
            start = start | ((F.col("_start.level") == i) & _in_path(i) & (F.col(f"_b{i}") >= F.col("_start.bucket")))
        near = x.where(start & ~_beyond(levels)).groupBy(*names, "score").agg(
            F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
        got = near.limit(MAX_POINTS + 1).collect()
        if len(got) > MAX_POINTS:
            return None
        points: dict[tuple, list] = {}
        for r in got:
            points.setdefault(tuple(r[n] for n in names), []).append((r["score"], r["tp"], r["fp"]))
        for g in open_:
            g.result = _resolve(g, sorted(points[g.key], reverse=True), prune)
        open_ = [g for g in open_ if g.result is None]
        want *= 64
    key = (lambda g: () if names == ["_all"] else g.key)
    return [(*key(g), *g.result) for g in groups]
