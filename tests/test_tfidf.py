"""Term counts and weights computed within the row, against plain Python."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hookline.functions.text import with_bigrams, word_tokens
from hookline.operators import heavy
from hookline.operators.tfidf import corpus_terms, tfidf_long, top_terms, with_idf


def terms_of(text):
    w = re.findall(r"\w{2,}", (text or "").lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def corpus(n=60):
    rng = random.Random(5)
    words = ["pay", "now", "bank", "Bank", "link", "a", "über", "x1", "login"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [None, "", "one", "same same same same", "pay, now! pay. now?"] + texts


def expected(texts):
    n, df = collections.Counter(), collections.Counter()
    for t in texts:
        n.update(terms_of(t))
        df.update(set(terms_of(t)))
    return n, df


def test_corpus_terms_equal_plain_counts(spark):
    texts = corpus()
    d = spark.createDataFrame(list(enumerate(texts)), "email_id long, raw_text string")
    n, df = expected(texts)
    got = {r["term"]: (r["n"], r["df"]) for r in corpus_terms(d, "raw_text").collect()}
    assert got.pop(None) == (len(texts), len(texts))
    assert got == {t: (n[t], df[t]) for t in n}


def test_counts_move_by_term_only(spark):
    d = spark.createDataFrame(list(enumerate(corpus())), "email_id long, raw_text string")
    plan = corpus_terms(d, "raw_text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan
    assert "hashpartitioning(term" in plan and "email_id" not in plan.split("Scan")[0]


@pytest.mark.parametrize("slice_tokens", [1 << 20, 3])
def test_weights_equal_plain_weights_without_a_shuffle(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(heavy, "SLICE_TOKENS", slice_tokens)
    texts = corpus()
    d = spark.createDataFrame(list(enumerate(texts)), "email_id long, raw_text string")
    c = corpus_terms(d, "raw_text")
    top = with_idf(top_terms(c, 20), c).cache()
    n, df = expected(texts)
    best = sorted(n, key=lambda t: (-n[t], t))[:20]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in best}
    assert {r["term"]: pytest.approx(r["idf"]) for r in top.collect()} == idf
    out = tfidf_long(d, "email_id", "raw_text", top)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in enumerate(texts):
        w = {x: c * idf[x] for x, c in collections.Counter(terms_of(t)).items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want |= {(i, x): v / norm for x, v in w.items()}
    got = {(r["email_id"], r["term"]): r["weight"] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def skewed(n=300, tail=4000):
    """Some words often, ties around every cut, and a long tail of words that occur once."""
    rng = random.Random(12)
    texts = []
    for i in range(n):
        w = [f"hot{min(int(rng.expovariate(0.3)), 40)}" for _ in range(30)] + [f"rare{i * 14 + j}" for j in range(14)]
        rng.shuffle(w)
        texts.append(w)
    return [[], *texts, [f"tie{j}" for j in range(50)] * 3]


@pytest.mark.parametrize("pairs", [False, True])
@pytest.mark.parametrize("k, capacity", [(10, 100), (30, 400), (45, 60), (60, 500), (100_000, None), (7, 7)])
def test_certified_top_equals_the_full_count(spark, monkeypatch, pairs, k, capacity):
    monkeypatch.setattr(heavy, "SLICE_TOKENS", 500)
    texts = skewed()
    d = spark.createDataFrame([(t,) for t in texts], "t array<string>").repartition(3)
    n, df = collections.Counter(), collections.Counter()
    for t in texts:
        terms = t + [f"{a} {b}" for a, b in zip(t, t[1:])] * pairs
        n.update(terms)
        df.update(set(terms))
    want = sorted(((t, n[t], df[t]) for t in n), key=lambda r: (-r[1], r[0]))[:k]
    got = [tuple(r) for r in heavy.top_counts(d, "t", k, pairs, capacity).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(tuple(r) for r in heavy.full_count(d, "t", pairs).collect()) == sorted((t, n[t], df[t]) for t in n)


def test_too_many_candidates_fall_back_to_the_full_count(spark, monkeypatch):
    d = spark.createDataFrame([([f"w{i}" for i in range(j, j + 50)],) for j in range(100)], "t array<string>")
    called = []
    real = heavy.full_count
    monkeypatch.setattr(heavy, "full_count", lambda *a: called.append(1) or real(*a))
    monkeypatch.setattr(heavy, "MAX_CANDIDATES", 20)
    got = [tuple(r) for r in heavy.top_counts(d, "t", 5, capacity=30).collect()]
    assert called and sorted(got) == sorted((f"w{i}", 50, 50) for i in range(49, 100))[:5]
    assert heavy.top_counts(d.where("false"), "t", 5).count() == 0


def test_bigrams_do_not_tokenise_again_for_every_pair(spark):
    texts = [None, "", "one", "pay, now! Pay. now?"]
    d = spark.createDataFrame(list(enumerate(texts)), "email_id long, raw_text string")
    made = d.select("email_id", with_bigrams(word_tokens(F.col("raw_text"))).alias("terms"))
    got = {r["email_id"]: r["terms"] for r in made.collect()}
    assert got == {i: None if t is None else terms_of(t) for i, t in enumerate(texts)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(" in plan
    assert all("regexp_extract_all" not in body.split(", lambda ")[0] for body in plan.split("lambdafunction(")[1:])


@pytest.mark.parametrize("pairs", [False, True])
def test_top_counts_cut_long_documents(spark, monkeypatch, pairs):
    texts = corpus(20) + [" ".join(["pay now bank"] * 40), "pay " * 50]
    d = spark.createDataFrame([(re.findall(r"\w{2,}", (t or "").lower()) if t is not None else None,) for t in texts], "t array<string>")
    n, df = (collections.Counter({t: c for t, c in x.items() if pairs or " " not in t}) for x in expected(texts))
    monkeypatch.setattr(heavy, "PIECE_TOKENS", 3)
    monkeypatch.setattr(heavy, "SLICE_TOKENS", 7)
    assert max(len(r["tokens"]) for r in heavy._pieces(d, "t").collect()) == 4
    got = [tuple(r) for r in heavy.top_counts(d, "t", 9, pairs).collect()]
    assert got == [(t, n[t], df[t]) for t in sorted(n, key=lambda t: (-n[t], t))[:9]]
