"""Models of all folds from common passes, against separate fits."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hookline.operators import newton
from hookline.operators.models import LinearAgent, fit_scaler, lr, raw_vector, scaled
from hookline.operators.newton import NewtonAgent, fit_folds
from hookline.operators.vocab import fold_token_freq, fold_vocab, token_freq, top_vocab, vocab_ids
from hookline.session import scratch_path

COLS = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3)) * [1.0, 50.0, 0.01] + [0.0, 1000.0, -1.0]
    y = ((x - [0, 1000, -1]) / [1, 50, 0.01] @ [1.0, -0.3, 2.0] + rng.normal(size=800) > 0).astype(int)
    data = [(i, int(i % 4 + 1), *map(float, r), 3.0, int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, fold int, a double, b double, c double, flat double, y int").repartition(5).cache()


def solve(df, fold, scale=True):
    """Newton on one training set, in numpy, for the same objective."""
    d = np.array([[*r[:-1], r[-1]] for r in df.where(F.col("fold") != fold).select(*COLS, "y").collect()], float)
    x, y = d[:, :-1], d[:, -1]
    std = x.std(0)
    if scale:
        x = (x - x.mean(0)) / np.where(std > 1e-9, std, 1)
    a = np.hstack([x, np.ones((len(x), 1))])
    reg, w = np.diag([1.0] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.lstsq(a.T @ (a * (p * (1 - p))[:, None]) + reg, a.T @ (p - y) + reg @ w, rcond=None)[0]
    return w


def test_all_folds_equal_separate_solutions(spark, rows, monkeypatch):
    jobs = []
    real = newton._evaluate
    monkeypatch.setattr(newton, "_evaluate", lambda *a: jobs.append(1) or real(*a))
    got = fit_folds(rows, COLS, "fold", [1, 2, 3, 4])
    assert len(jobs) < 13   # with the write and the moments fewer than 15 jobs for all folds
    for t, agent in got.items():
        w = solve(rows, t)
        assert np.allclose(agent.weights, w[:-1], atol=1e-6) and agent.intercept == pytest.approx(w[-1], abs=1e-6)
        want = fit_scaler(rows.where(F.col("fold") != t), COLS)
        assert all(agent.stats[c] == pytest.approx(want[c], rel=1e-9, abs=1e-9) for c in COLS)


def test_equals_the_gradient_solver(spark, rows):
    """Same coefficients as Spark's own regression when that runs to a tight tolerance."""
    train = rows.where(F.col("fold") != 2)
    stats = fit_scaler(train, COLS)
    x = train.select(raw_vector(COLS).alias("_raw"), F.col("y").cast("double").alias("label")) \
             .select(scaled("_raw", COLS, stats).alias("features"), "label")
    want = lr(train.count()).setTol(1e-12).fit(x)
    got = fit_folds(rows, COLS, "fold", [2])[2]
    assert np.allclose(got.weights, want.coefficients.toArray(), atol=1e-6)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-6)
    p = {r["id"]: r["p"] for r in LinearAgent(COLS).fit(train).score(rows, "p").select("id", "p").collect()}
    q = {r["id"]: r["p"] for r in got.score(rows, "p").select("id", "p").collect()}
    assert max(abs(p[i] - q[i]) for i in p) < 1e-3


def test_whole_table_unscaled_saved_and_read(spark, rows):
    agent = NewtonAgent(["a", "c"], scale=False).fit(rows)
    path = scratch_path(spark, "newton")
    agent.save(path)
    again = NewtonAgent.load(spark, path)
    assert again == agent
    a, b = (sorted(m.score(rows.select("id", "a", "c"), "p").collect()) for m in (agent, again))
    assert a == b and len(a) == 800


def test_separable_missing_and_single_class(spark):
    rows = [(float(i), None if i % 5 == 0 else 1.0, int(i >= 50), i % 4 + 1) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, y int, fold int")
    agent = fit_folds(df, ["a", "b"], "fold", [1, 2])[1]
    got = [r["p"] for r in agent.score(df.orderBy("a"), "p").collect()]
    assert got[0] < 0.1 < 0.9 < got[-1]
    ones = fit_folds(df.withColumn("y", F.lit(1)), ["a", "b"], "fold", [3])[3]
    assert {round(r["p"], 9) for r in ones.score(df, "p").collect()} == {1.0}
    none = fit_folds(df.where("false"), ["a", "b"], "fold", [3])[3]
    assert {r["p"] for r in none.score(df, "p").collect()} == {0.5}


def test_one_pass_gives_every_folds_vocabulary(spark):
    import random
    rng = random.Random(1)
    data = [(i, [f"w{min(int(rng.expovariate(0.2)), 60)}" for _ in range(rng.randrange(30))], i % 4 + 1, rng.random() < 0.2)
            for i in range(400)]
    df = spark.createDataFrame(data, "email_id long, tokens array<string>, fold int, cal boolean")
    outside = {t: (F.col("fold") == t) | F.col("cal") for t in range(1, 5)}
    freq = fold_token_freq(df, outside)
    assert freq._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for t in range(1, 5):
        want = vocab_ids(top_vocab(token_freq(df.where(~outside[t]), "email_id")))
        assert sorted(fold_vocab(freq, t).collect()) == sorted(want.collect())


def test_mail_is_scored_by_the_model_of_the_feature_table(spark):
    """The query's scores are the fitted model's on the vector brought to its width; no URL gives the prior."""
    import __spark_entry__ as entry
    from hookline.functions.urls import FEATURES_5_V2
    from hookline.operators.email_urls import agg_names, email_url_features_inrow
    from hookline.sources import csv as C
    from hookline.sources import fixtures as X
    from hookline.sources.tables import mail
    sf = "/root/testdata/sf0.001"
    got = {r["email_id"]: r for r in entry.queries()["ml_lexical_table_score"](spark, sf).collect()}
    ft = C.load_feature_table(spark, X.write_feature_table(spark, sf))
    agent = NewtonAgent([c for c in ft.columns if c != "y"]).fit(ft)
    names = agg_names(FEATURES_5_V2)
    rows = email_url_features_inrow(mail(spark, sf), FEATURES_5_V2).collect()
    assert len(rows) == len(got) and {r["n_urls"] > 0 for r in rows} == {True, False}
    for r in rows:
        v = [r[n] for n in names][:len(agent.cols)] + [0.0] * (len(agent.cols) - len(names))
        z = agent.intercept + sum(w * (x - agent.stats[c][0]) / (agent.stats[c][1] or 1.0) for w, x, c in zip(agent.weights, v, agent.cols))
        want = 1 / (1 + np.exp(-z)) if r["n_urls"] else 0.5
        assert got[r["email_id"]]["p_lexical"] == pytest.approx(want, abs=1e-9)
