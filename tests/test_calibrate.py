"""Thresholds found by search equal those of the whole curve."""

import math
import random

import pytest

from hookline.operators import calibrate as C
from hookline.operators.roc import calibrate, roc_points


def same(a, b):
    return len(a) == len(b) and all(
        x == y or isinstance(x, float) and isinstance(y, float) and (math.isnan(x) and math.isnan(y) or abs(x - y) < 1e-12)
        for r, s in zip(a, b) for x, y in zip(r, s))


def cases():
    rng = random.Random(2)
    out = {}
    out["overlap"] = [(rng.gauss(0.4 + 0.2 * y, 0.15), y) for y in (rng.randrange(2) for _ in range(900))]
    out["ties"] = [(round(rng.random() * 0.6 + 0.3 * y, 2), y) for y in (rng.randrange(2) for _ in range(900))]
    out["run of single negatives"] = [(1.0 + i / 1000, 1) for i in range(50)] + [(1 - i / 1000, 0) for i in range(800)]
    out["run of pairs"] = [(1 - i / 1000, y) for i in range(500) for y in (0, 1)]
    out["top is a negative"] = [(0.99, 0)] + [(0.5 + i / 1000, 1) for i in range(50)] + [(0.1, 0)] * 60
    out["one score"] = [(0.5, y) for y in (0, 1, 1)]
    out["no negative"] = [(0.1 * i, 1) for i in range(5)]
    out["no positive"] = [(0.1 * i, 0) for i in range(300)]
    out["wide"] = [(10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]), rng.randrange(2)) for _ in range(400)]
    out["dense"] = [(0.5 + rng.random() * 1e-12, rng.randrange(2)) for _ in range(600)] + [(1e9, 1)]
    return out


@pytest.mark.parametrize("few, buckets", [(20_000, 4096), (3, 8)])
def test_equals_the_whole_curve(spark, monkeypatch, few, buckets):
    monkeypatch.setattr(C, "FEW_ROWS", few)
    monkeypatch.setattr(C, "BUCKETS", buckets)
    rows = [(name, s, y) for name, v in cases().items() for s, y in v]
    df = spark.createDataFrame(rows, "g string, s double, y int").repartition(4).cache()
    for alpha in (0.0, 0.005, 0.1, 1.0):
        for prune in (True, False):
            want = calibrate(roc_points(df, ["g"], "s", "y", prune=prune), ["g"], alpha, use_pruned=prune)
            got = C.search_threshold(df, ["g"], "s", "y", alpha, prune)
            assert got.columns == want.columns
            a, b = (sorted(map(tuple, x.collect())) for x in (got, want))
            assert same(a, b), (alpha, prune, [(x, y) for x, y in zip(a, b) if not same([x], [y])])


def test_without_groups_fallback_and_empty(spark, monkeypatch):
    df = spark.createDataFrame(cases()["run of single negatives"], "s double, y int")
    want = calibrate(roc_points(df, [], "s", "y", prune=True), []).collect()
    assert C.search_threshold(df, [], "s", "y").collect() == want
    monkeypatch.setattr(C, "MAX_POINTS", 5)
    assert C.search_threshold(df, [], "s", "y").collect() == want
    assert C.search_threshold(df.where("false"), [], "s", "y").count() == 0
