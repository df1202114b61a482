"""Stratified k-fold assignment, fold complements and the exact calibration holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CAL_SHARE, N_FOLDS, SEED
from .rank import hash_order, hash_rank


def stratified_folds(df: DataFrame, key: str = "email_id", label: str = "y",
                     k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` in 1..k: rows of each class dealt round-robin in md5(seed:key) order.

    Every row is in exactly one fold; per class, fold sizes differ by at most one.
    """
    r = hash_rank(df, [label], key, seed, out="_r", max_groups=2)   # labels are 0/1
    return r.withColumn("fold", (F.pmod(F.col("_r") - 1, F.lit(k)) + 1).cast("int")).drop("_r")


def fold_list(spark, k: int = N_FOLDS) -> DataFrame:
    return spark.range(1, k + 1).select(F.col("id").cast("int").alias("train_fold"))


def fold_complement(df: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """One row per (training fold t, row) with row.fold != t: all k training sets at once.

    A non-equi join against the k-row fold list; k is a parameter, so the
    broadcast side is bounded by construction.
    """
    folds = F.broadcast(fold_list(df.sparkSession, k))
    return df.join(folds, df["fold"] != folds["train_fold"], "inner")


def fold_complement_by_filter(df: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """Same rows as ``fold_complement``, as the per-fold filter a fold loop uses."""
    parts = [df.where(F.col("fold") != t).withColumn("train_fold", F.lit(t)) for t in range(1, k + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Hash buckets of the cut search: a crossing bucket holds about 1 / 65,536 of a training set.
CUT_DIGITS = 4


def _cut_order(key: str, train_fold: Column, seed: int) -> Column:
    return hash_order(F.lit(seed) + train_fold, F.col(key))[0]


def holdout_cuts(df: DataFrame, key: str = "email_id", k: int = N_FOLDS,
                 share: float = CAL_SHARE, seed: int = SEED) -> DataFrame:
    """``(train_fold, n_train, n_cal, cut_hash, cut_key)``: one row per training fold.

    The calibration rows of training fold t are the first floor(share * n_t) rows in
    order of md5((seed + t):key), that is all up to a cut; the cut is null if there are
    none. It is selected without ranking any row: a histogram of the hash (k - 1 bucket
    numbers a row, summed before they leave the task, at most k x 65,536 rows
    after) tells the bucket in which the count crosses, and only that bucket's rows are ordered.
    Rows with the cut's own key fall on one side together.
    """
    shift = 4 * (15 - CUT_DIGITS)
    marks = F.array(*[F.struct(F.lit(t).alias("train_fold"), _cut_order(key, F.lit(t), seed).alias("h"))
                      for t in range(1, k + 1)])
    rows = df.select("fold", key, F.inline(marks)).where((F.col("fold") != F.col("train_fold")) & F.col("h").isNotNull()) \
             .select("train_fold", key, "h", F.shiftright("h", shift).alias("_b"))
    counts = rows.groupBy("train_fold", "_b").agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy("train_fold").orderBy("_b"), Window.partitionBy("train_fold")
    n_cal = F.floor(F.lit(share) * F.col("n_train"))
    run = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("n_train", F.sum("n").over(whole)) \
                .withColumn("n_cal", n_cal)
    sizes = run.groupBy("train_fold").agg(F.max("n_train").alias("n_train"), F.max("n_cal").alias("n_cal"))
    crossing = run.where((F.col("upto") >= F.col("n_cal")) & (F.col("upto") - F.col("n") < F.col("n_cal"))) \
                  .select("train_fold", "_b", (F.col("n_cal") - F.col("upto") + F.col("n")).alias("_need"))   # k rows
    inside = rows.join(F.broadcast(crossing), ["train_fold", "_b"])
    place = F.row_number().over(Window.partitionBy("train_fold").orderBy("h", key))
    cut = inside.withColumn("_r", place).where(F.col("_r") == F.col("_need")) \
                .select("train_fold", F.col("h").alias("cut_hash"), F.col(key).alias("cut_key"))
    return sizes.join(F.broadcast(cut), "train_fold", "left")


def before_cut(key: str, train_fold: Column, cut_hash: Column, cut_key: Column, seed: int = SEED) -> Column:
    """Whether a row of ``train_fold``'s training set calibrates."""
    h = _cut_order(key, train_fold, seed)
    return F.coalesce((h < cut_hash) | ((h == cut_hash) & (F.col(key) <= cut_key)), F.lit(False))


def holdout_split(df: DataFrame, key: str = "email_id", k: int = N_FOLDS,
                  share: float = CAL_SHARE, seed: int = SEED) -> DataFrame:
    """For each training fold t: floor(share * n_t) rows flagged ``is_cal``, the rest fit the models.

    The flag is a comparison with the fold's cut: no rank, no window over the rows.
    """
    cuts = holdout_cuts(df, key, k, share, seed).select("train_fold", "cut_hash", "cut_key")   # k rows
    j = fold_complement(df, k).join(F.broadcast(cuts), "train_fold", "left")
    flag = before_cut(key, F.col("train_fold"), F.col("cut_hash"), F.col("cut_key"), seed)
    return j.select(*df.columns, "train_fold", flag.alias("is_cal"))


def calibration_flags(df: DataFrame, key: str = "email_id", k: int = N_FOLDS,
                      share: float = CAL_SHARE, seed: int = SEED) -> dict[int, Column]:
    """Per fold t a column of ``df``: whether a row calibrates t, null on t's test rows. The k cuts
    are collected, so the flags are comparisons within the row."""
    cuts = {r["train_fold"]: r for r in holdout_cuts(df, key, k, share, seed).collect()}
    out = {}
    for t in range(1, k + 1):
        r = cuts.get(t)
        flag = F.lit(False) if r is None or r["cut_hash"] is None else \
            before_cut(key, F.lit(t), F.lit(r["cut_hash"]), F.lit(r["cut_key"]), seed)
        out[t] = F.when(F.col("fold") != t, flag)
    return out
