import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hookline.operators.models import LinearAgent, fit_scaler
from hookline.plans.q_stream import prior_route, stream_score_route
from hookline.session import scratch_path
from hookline.sources.tables import emails

SF001 = "/root/testdata/sf0.001"


def newton_lr(X, y, C=1.0, iters=50):
    """Independent solve of C * sum(log-loss) + |w|^2 / 2 (intercept unpenalised)."""
    n, d = X.shape
    A = np.hstack([X, np.ones((n, 1))])
    w = np.zeros(d + 1)
    reg = np.eye(d + 1) / C
    reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-A @ w))
        g = A.T @ (p - y) + reg @ w
        H = A.T @ (A * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(H, g)
    return w


def test_lr_matches_newton_solution(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.2] + [0.0, 2.0, -1.0]
    y = (X @ [1.0, -0.3, 2.0] + rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(t)) for (a, b, c), t in zip(X, y)],
                               "a double, b double, c double, y int")
    agent = LinearAgent(["a", "b", "c"]).fit(df)
    mean, std = X.mean(axis=0), X.std(axis=0)          # population std, as the scaler uses
    w = newton_lr((X - mean) / std, y)
    lrm = agent.model.stages[-1]
    assert np.allclose(lrm.coefficients.toArray(), w[:3], atol=1e-4)
    assert lrm.intercept == pytest.approx(w[3], abs=1e-4)
    stats = fit_scaler(df, ["a", "b", "c"])
    assert stats["b"][1] == pytest.approx(std[1], rel=1e-9)


def test_saved_agent_scores_identically(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), i % 2) for i in range(60)], "a double, b double, y int")
    agent = LinearAgent(["a", "b"]).fit(df)
    path = scratch_path(spark, "agent")
    agent.save(path)
    again = LinearAgent.load(spark, path)
    s1 = {tuple(r) for r in agent.score(df, "p").select("a", "b", F.round("p", 12)).collect()}
    s2 = {tuple(r) for r in again.score(df, "p").select("a", "b", F.round("p", 12)).collect()}
    assert s1 == s2


def test_stream_equals_batch(spark):
    batch = {tuple(r) for r in prior_route(emails(spark, SF001)).collect()}
    stream = {tuple(r) for r in stream_score_route(spark, SF001).select("email_id", "y", "n_urls", "score", "action").collect()}
    assert batch == stream and len(batch) == 87


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["email_id", "y", "n_urls", "score", "action"]
    assert df.count() == 87
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 90


def test_encoder_scores_with_numpy_head(spark):
    from hookline.operators.models import encoder_scores

    def make():
        import numpy as np

        def predict(texts):
            lengths = np.array([len(t) for t in texts], dtype=float)
            return 1.0 / (1.0 + np.exp(-(lengths - 10.0)))
        return predict
    df = spark.createDataFrame([("short",), ("a much longer text here",)], "text string")
    got = [r["p_semantic"] for r in encoder_scores(df, "text", make).collect()]
    assert got[0] < 0.5 < got[1]


def test_missing_feature_counts_as_zero(spark):
    rows = [(float(i % 7) or None, float(i % 3), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    full = df.fillna(0.0)
    agent = LinearAgent(["a", "b"]).fit(df)
    want = LinearAgent(["a", "b"]).fit(full).stats   # partial sums meet in any order
    assert all(agent.stats[c] == pytest.approx(want[c], rel=1e-12) for c in ("a", "b"))
    p = [sorted(r["p"] for r in agent.score(d, "p").collect()) for d in (df, full)]
    assert p[0] == pytest.approx(p[1], abs=1e-12)
