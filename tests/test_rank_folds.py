import random

from pyspark.sql import Window
from pyspark.sql import functions as F

import hookline.operators.rank as R
from hookline.operators.folds import calibration_flags, fold_complement, fold_complement_by_filter, holdout_split, stratified_folds


def test_prefix_sums_equal_naive_window(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 1]), rng.choice([0.1, 0.25, 0.5, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g int, x double")
    monkeypatch.setattr(R, "TARGET_BUCKET_ROWS", 100)   # force many buckets
    splits = R.percentile_splits(df, "x", df.count())
    assert len(splits) > 4
    b = R.with_bucket(df, "x", splits, "b")
    got = R.prefix_sums(b, ["g"], F.col("b"), [F.col("x"), F.col("id")], {"cs": F.col("x")}, totals=True)
    w = Window.partitionBy("g").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = df.select("id", F.sum("x").over(w).alias("ref"), F.sum("x").over(Window.partitionBy("g")).alias("tot"))
    j = got.join(ref, "id").collect()
    assert len(j) == 3000
    assert all(abs(r["cs"] - r["ref"]) < 1e-9 and abs(r["total_cs"] - r["tot"]) < 1e-9 for r in j)


def test_stratified_folds_balance(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(1001)]
    f = stratified_folds(spark.createDataFrame(rows, "email_id long, y int")).collect()
    assert len(f) == 1001 and len({r["email_id"] for r in f}) == 1001
    for y in (0, 1):
        sizes = [sum(1 for r in f if r["y"] == y and r["fold"] == k) for k in range(1, 5)]
        assert max(sizes) - min(sizes) <= 1


def test_fold_complement_forms_agree_and_holdout_is_exact(spark):
    rows = [(i, i % 3 == 0 and 1 or 0) for i in range(500)]
    f = stratified_folds(spark.createDataFrame(rows, "email_id long, y int"))
    a = sorted(tuple(r) for r in fold_complement(f).select("train_fold", "email_id").collect())
    b = sorted(tuple(r) for r in fold_complement_by_filter(f).select("train_fold", "email_id").collect())
    assert a == b and len(a) == 1500
    h = holdout_split(f).collect()
    for k in range(1, 5):
        n = sum(1 for r in h if r["train_fold"] == k)
        assert sum(1 for r in h if r["train_fold"] == k and r["is_cal"]) == int(0.2 * n)


def test_holdout_is_the_hash_order_and_ranks_nothing(spark):
    """The cut equals the first rows of a full sort, whatever the size; no row is copied or ranked."""
    import hashlib
    for n in (0, 3, 6, 50, 2000):
        df = spark.createDataFrame([(i * 7, i % 4 + 1) for i in range(n)], "email_id long, fold int")
        got = {(r["train_fold"], r["email_id"]) for r in holdout_split(df).where("is_cal").collect()}
        want = set()
        for t in range(1, 5):
            train = sorted((hashlib.md5(f"{42 + t}:{i * 7}".encode()).hexdigest()[:15], i * 7) for i in range(n) if i % 4 + 1 != t)
            want |= {(t, i) for _, i in train[:int(0.2 * len(train))]}
        assert got == want
        flags = calibration_flags(df)
        rows = df.select("email_id", "fold", *[c.alias(f"c{t}") for t, c in flags.items()]).collect()
        assert {(t, r["email_id"]) for r in rows for t in range(1, 5) if r[f"c{t}"]} == want
        assert all((r[f"c{t}"] is None) == (r["fold"] == t) for r in rows for t in range(1, 5))
    plan = holdout_split(df)._jdf.queryExecution().executedPlan().toString()
    # the one rank is below the join with the crossing buckets, on 1/65,536 of the rows
    assert plan.count("row_number()") <= 2 and "RoundRobin" not in plan
