import random

import pytest
from pyspark.sql import functions as F

from hookline.operators.metrics import confusion, rates
from hookline.operators.policy import check_weights, late_fusion, policy_tiers, policy_v0, tau_block
from hookline.operators.roc import auc, calibrate, roc_points

CASE = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0), (0.4, 0)]


def frame(spark, pairs):
    return spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(pairs)], "id long, score double, y int")


def calib(spark, pairs, alpha):
    pts = roc_points(frame(spark, pairs), [], "score", "y", prune=True)
    return calibrate(pts, [], alpha).first()


def test_calibration_golden_cases(spark):
    r = calib(spark, CASE, 0.005)
    assert r["tau_cal"] == 0.8 and r["feasible"] and r["tpr_at_tau"] == pytest.approx(2 / 3)
    r = calib(spark, CASE, 0.34)
    assert r["tau_cal"] == 0.6 and r["feasible"]
    r = calib(spark, [(0.9, 0), (0.8, 1)], 0.005)
    assert r["tau_cal"] == 0.8 and not r["feasible"]


def test_metrics_golden_case(spark):
    df = frame(spark, CASE).withColumn("y_pred", (F.col("score") >= 0.8).cast("int")).withColumn("fold", F.lit(1))
    m = rates(confusion(df, ["fold"])).first()
    assert (m["TP"], m["FP"], m["TN"], m["FN"]) == (2, 0, 3, 1)
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"], m["fpr"]) == (0.8333, 1.0, 0.6667, 0.8, 0.0)
    a = auc(roc_points(frame(spark, CASE), [], "score", "y")).first()["auc"]
    assert a == pytest.approx(8 / 9)
    assert spark.range(1).select(tau_block(F.lit(0.8))).first()[0] == pytest.approx(0.9)
    assert spark.range(1).select(tau_block(F.lit(0.95))).first()[0] == 1.0


def test_auc_symmetry_with_ties(spark):
    rng = random.Random(3)
    pairs = [(round(rng.random(), 1), rng.choice([0, 1])) for _ in range(400)]
    a = auc(roc_points(frame(spark, pairs), [], "score", "y")).first()["auc"]
    b = auc(roc_points(frame(spark, [(1 - s, y) for s, y in pairs]), [], "score", "y")).first()["auc"]
    assert a + b == pytest.approx(1.0)


def _drop_intermediate(points):
    """Reference rule: keep first, last and points where the 2nd difference of fp or tp is non-zero."""
    keep = [True] + [False] * (len(points) - 2) + [True] if len(points) > 2 else [True] * len(points)
    for j in range(1, len(points) - 1):
        (t0, f0), (t1, f1), (t2, f2) = points[j - 1], points[j], points[j + 1]
        keep[j] = (f2 - 2 * f1 + f0) != 0 or (t2 - 2 * t1 + t0) != 0
    return keep


def test_prune_matches_rule(spark):
    rng = random.Random(11)
    pairs = [(round(rng.random(), 2), rng.choice([0, 1])) for _ in range(500)]
    pts = roc_points(frame(spark, pairs), [], "score", "y", prune=True).orderBy(F.col("score").desc()).collect()
    expect = _drop_intermediate([(r["tp"], r["fp"]) for r in pts])
    assert [r["kept"] for r in pts] == expect


def test_fusion_and_policies(spark):
    r = spark.range(1).select(late_fusion(F.lit(0.9), F.lit(0.6), F.lit(0.3)).alias("p")).first()["p"]
    assert r == pytest.approx(0.6)
    with pytest.raises(ValueError):
        check_weights((0.5, 0.5, 0.5))
    df = spark.createDataFrame([(0.6,), (0.5,), (0.49,)], "p double")
    acts = [x[0] for x in df.select(policy_tiers(F.col("p"), F.lit(0.5), F.lit(0.6))).collect()]
    assert acts == ["BLOCK", "MONITOR", "ALLOW"]
    df = spark.createDataFrame([(0.85,), (0.5,), (0.4999,)], "p double")
    assert [x[0] for x in df.select(policy_v0(F.col("p"))).collect()] == ["quarantine", "mirror", "deliver"]
