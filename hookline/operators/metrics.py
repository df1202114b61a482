"""Confusion counts and the derived metrics, per group, as one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1", "fpr", "auc")


def confusion(df: DataFrame, group: list[str], label: str = "y", pred: str = "y_pred") -> DataFrame:
    """TP, FP, TN, FN per group; always four counts, even when a class is absent."""
    y, p = F.col(label), F.col(pred)

    def count_if(c: Column) -> Column:
        return F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
    return df.groupBy(*group).agg(count_if((y == 1) & (p == 1)).alias("TP"), count_if((y == 0) & (p == 1)).alias("FP"),
                                  count_if((y == 0) & (p == 0)).alias("TN"), count_if((y == 1) & (p == 0)).alias("FN"))


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 (zero division -> 0, rounded 4) and FPR in percent (rounded 2)."""
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    return counts.select(
        "*",
        F.round(_safe_div(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        F.round(_safe_div(tp, tp + fp), 4).alias("precision"),
        F.round(_safe_div(tp, tp + fn), 4).alias("recall"),
        F.round(_safe_div(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
        F.round(_safe_div(fp, fp + tn) * 100.0, 2).alias("fpr"))


def cv_summary(fold_metrics: DataFrame, metrics=METRICS) -> DataFrame:
    """Mean and population std of each metric over folds (long format)."""
    long = fold_metrics.select("fold", *[F.col(m).cast("double").alias(m) for m in metrics]) \
                       .unpivot("fold", list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"),
                                      F.round(F.stddev_pop("value"), 6).alias("std"))


def cv_pooled(fold_metrics: DataFrame) -> DataFrame:
    return fold_metrics.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("TP", "FP", "TN", "FN")])
