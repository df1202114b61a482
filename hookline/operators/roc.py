"""ROC curve, AUC and ROC-guided threshold calibration as grouped Spark jobs.

All three work per ``group`` (e.g. per fold) and never order the whole table
in one task: scores are first collapsed to one row per distinct score (partial
aggregation, so a score shared by a third of the rows is one row), then the
running counts use the two-level prefix sum of ``rank``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ALPHA
from ..session import ensure_checkpoint_dir
from .rank import next_in_order, percentile_splits, prefix_sums, with_bucket

def _nan():
    return F.lit(float("nan"))


def score_increments(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """``(group..., score, tp_d, fp_d)``: positives and negatives at each distinct score."""
    y = F.col(label).cast("bigint")
    return df.groupBy(*group, F.col(score).alias("score")).agg(
        F.sum(y).alias("tp_d"), F.sum(F.lit(1) - y).alias("fp_d"))


def roc_points(df: DataFrame, group: list[str] | None = None, score: str = "score", label: str = "y",
               prune: bool = False, max_groups: int | None = None) -> DataFrame:
    """One row per distinct score, descending: cumulative tp/fp, P, N, tpr, fpr.

    With ``prune``, collinear points are dropped the way the default ROC curve
    of the reproduced code does: keep the first and last point and every point
    whose increment differs from the next point's increment. ``kept`` marks them.
    """
    group = list(group or [])
    # Read three times (count, split points, running sums): cut the lineage with a
    # reliable checkpoint in the shared folder rather than holding executor memory.
    ensure_checkpoint_dir(df.sparkSession)
    inc = score_increments(df, group, score, label).checkpoint(eager=True)
    splits = percentile_splits(inc, "score", inc.count())
    nb = len(splits) - 2
    inc_b = with_bucket(inc, "score", splits, "_bi").withColumn("_bd", F.lit(nb) - F.col("_bi")).drop("_bi")
    order = [F.col("score").desc()]
    cum = prefix_sums(inc_b, group, F.col("_bd"), order,
                      {"tp": F.col("tp_d"), "fp": F.col("fp_d")}, totals=True,
                      max_groups=max_groups if group else 1)
    cum = cum.withColumnRenamed("total_tp", "n_pos").withColumnRenamed("total_fp", "n_neg")
    if prune:
        cum = next_in_order(cum, group, "_bd", order, ["tp_d", "fp_d"], head_key=-F.col("score"))
        first = (F.col("tp") == F.col("tp_d")) & (F.col("fp") == F.col("fp_d"))
        last = F.col("next_tp_d").isNull()
        bend = (F.col("next_tp_d") != F.col("tp_d")) | (F.col("next_fp_d") != F.col("fp_d"))
        cum = cum.withColumn("kept", first | last | bend).drop("next_tp_d", "next_fp_d")
    cum = cum.drop("_bd")
    return cum.withColumn("tpr", F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(_nan())) \
              .withColumn("fpr", F.when(F.col("n_neg") > 0, F.col("fp") / F.col("n_neg")).otherwise(_nan()))


def with_origin(points: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Prepend the (threshold=+inf, tp=0, fp=0) point the curve starts from."""
    group = list(group or [])
    heads = points.groupBy(*group).agg(F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    origin = heads.select(*group, F.lit(math.inf).alias("score"), F.lit(0).cast("bigint").alias("tp"),
                          F.lit(0).cast("bigint").alias("fp"), "n_pos", "n_neg",
                          F.when(F.col("n_pos") > 0, F.lit(0.0)).otherwise(_nan()).alias("tpr"),
                          F.when(F.col("n_neg") > 0, F.lit(0.0)).otherwise(_nan()).alias("fpr"))
    cols = [*group, "score", "tp", "fp", "n_pos", "n_neg", "tpr", "fpr"]
    return points.select(*cols).unionByName(origin)


def auc(points: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Tie-aware trapezoid ROC AUC per group; null when a class is missing.

    Each distinct score adds fp_d * (tp_before + tp_after) / 2 to the area, i.e.
    fp_d * (2 * tp - tp_d) / 2 from its own cumulative row -- no lag needed.
    """
    group = list(group or [])
    area2 = F.sum(F.col("fp_d").cast("double") * (2 * F.col("tp") - F.col("tp_d")).cast("double"))
    pn = F.first("n_pos").cast("double") * F.first("n_neg").cast("double")
    return points.groupBy(*group).agg(F.when(pn > 0, area2 / (2.0 * pn)).alias("auc"))


def calibrate(points: DataFrame, group: list[str] | None = None, alpha: float = ALPHA,
              use_pruned: bool = True) -> DataFrame:
    """Threshold with the highest TPR subject to FPR <= alpha; ties -> the higher threshold.

    When no point with positive TPR satisfies the ceiling, the lowest score is
    returned and ``feasible`` is false (every row is then flagged).
    """
    group = list(group or [])
    ok = (F.col("fpr") <= F.lit(alpha)) & (F.col("tp") > 0)
    if use_pruned and "kept" in points.columns:
        ok = ok & F.col("kept")
    best = F.max(F.when(ok, F.struct("tp", "score", "fp", "tpr", "fpr")))
    agg = points.groupBy(*group).agg(best.alias("_best"), F.min("score").alias("_low"),
                                     F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    return agg.select(*group,
                      F.coalesce(F.col("_best.score"), F.col("_low")).alias("tau_cal"),
                      F.col("_best").isNotNull().alias("feasible"),
                      F.coalesce(F.col("_best.tpr"), F.when(F.col("n_pos") > 0, F.lit(1.0)).otherwise(_nan())).alias("tpr_at_tau"),
                      F.coalesce(F.col("_best.fpr"), F.when(F.col("n_neg") > 0, F.lit(1.0)).otherwise(_nan())).alias("fpr_at_tau"))
