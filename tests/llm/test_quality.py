"""Naive Bayes support vectors against brute force, and their defined results on odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hookline.llm import quality
from hookline.llm.common import table

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, good long, half long"


def held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 1


def brute_terms(text):
    """All terms of a text as plain tuples."""
    b = (text or "").encode()
    out = {("byte", b[i:i + k]) for k in range(1, 4) for i in range(len(b) - k + 1)}
    folded = bytes(ord("a") if x >= 128 or 97 <= x <= 122 else ord("A") if 65 <= x <= 90 else ord("0") if 48 <= x <= 57
                   else 32 if x in (9, 10, 11, 12, 13, 32) else x for x in b)
    runs = bytes(x for i, x in enumerate(folded) if not i or folded[i - 1] != x)
    out |= {("shape", runs[i:i + k]) for k in range(2, 5) for i in range(len(runs) - k + 1)}
    w = b.lower().split()
    out |= {("word", x) for x in w} | {("pair", x) for x in zip(w, w[1:])}
    same = [x == y for x, y in zip(w, w[1:])]
    out |= {("same", tuple(same[i:i + k])) for k in (1, 2, 3) for i in range(len(same) - k + 1)}
    return out


def texts(n=40):
    rng = random.Random(3)
    words = ["a", "b!", "b!", "Ab", "ÉB", "x7", "x7", "|", "**", "cd"]
    return ["", None, "a", " \n", "a a a a a", "aa aa b b"] + [
        " ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("window", [1 << 20, 7])
def test_terms_equal_brute_force(monkeypatch, window):
    """Two rows share a term's hash if and only if they share the term, whatever the window."""
    monkeypatch.setattr(quality, "WINDOW", window)
    rows = texts()
    got = [set() for _ in rows]
    for family in quality.families(pa.array(rows)):
        for h, row, ok in family:
            for x, r, o in zip(h.tolist(), row.tolist(), ok.tolist() if ok is not None else [True] * len(h)):
                if o:
                    got[r].add(x)
    want = [brute_terms(t) for t in rows]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(rows)):
        for j in range(i):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_term_counts_equal_brute_force():
    rows = texts()
    good = [i % 3 != 0 for i in range(len(rows))]
    half = [i % 2 for i in range(len(rows))]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string()), "good": pa.array(good).cast(pa.int64()),
                                        "half": pa.array(half)})
    got = sorted(int(n) for out in quality._term_counts([batch]) for c in out.columns[1:] for n in c.to_pylist() if n)
    want = {}
    for t, g, f in zip(rows, good, half):
        for term in brute_terms(t):
            want[term, g, f] = want.get((term, g, f), 0) + 1
    assert got == sorted(want.values())


def test_vocabulary_finds_terms_that_share_a_place():
    rng = np.random.default_rng(0)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500).astype(np.uint64),
                                     np.arange(40, dtype=np.uint64) + np.uint64(5 << 44)]))
    v = quality.Vocabulary(keys)
    h = np.concatenate([keys[::-1], keys + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    hit, term = v.find(h)
    assert sorted(zip(hit.tolist(), term.tolist())) == [(i, int(np.searchsorted(v.keys, x))) for i, x in enumerate(h)
                                                        if x in set(keys.tolist())]


def hinge_loss(x, y, w, b, c):
    return (w @ w + b * b) / 2 + c * np.maximum(0, 1 - y * (x @ w + b)).sum()


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal value equals the dual bound, and no nearby weights are better."""
    rng = np.random.default_rng(1)
    value = rng.normal(size=30)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(120)]
    y = np.where([value[r].sum() + rng.normal() > 0 for r in rows], 1.0, -1.0)
    w, b = quality.fit_hinge(rows, y, value, tolerance=1e-6)
    x = np.zeros((120, 30))
    for i, r in enumerate(rows):
        x[i, r] = value[r] / max(np.linalg.norm(value[r]), 1e-12)
    best = hinge_loss(x, y, w, b, quality.PENALTY)
    for _ in range(300):
        d = rng.normal(size=31) * 10.0 ** rng.integers(-4, 0)
        assert hinge_loss(x, y, w + d[:30], b + d[30], quality.PENALTY) >= best - 1e-6
    assert np.allclose(quality.margins(rows, value, w, b), x @ w + b)


def test_sigmoid_is_the_most_likely_one():
    rng = np.random.default_rng(2)
    s = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * s - 0.5)))).astype(float)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a, b):
        z = a * s + b
        return (np.logaddexp(0, z) - t * z).sum()
    a, b = quality.fit_sigmoid(s, y)
    for da in (-1e-2, 0, 1e-2):
        for db in (-1e-2, 0, 1e-2):
            assert loss(a, b) <= loss(a + da, b + db) + 1e-9
    a, b = quality.fit_sigmoid(np.array([-1.0, -2.0, 1.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert np.isfinite([a, b]).all() and a > 0


def test_held_out_rows_are_told_apart(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in quality.op11(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    truth = {r.doc_id: r.quality for r in labels.collect() if held_out(r.doc_id) and r.doc_id in got}
    good = [got[d].score for d, q in truth.items() if q == 1]
    bad = [got[d].score for d, q in truth.items() if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.98 and np.mean([s >= 0.5 for s in good]) > 0.97


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    rows = [(r.doc_id, 1 - r.quality if held_out(r.doc_id) else r.quality, 0) for r in labels.collect()]
    turned = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    a = sorted(quality.op11(docs, labels).collect())
    assert a == sorted(quality.op11(docs.repartition(7), turned).collect())


def test_odd_rows(spark):
    rows = [(1, "fine words here", "en", 0.1, 1, 1), (1, "fine words here", "en", 0.1, 1, 1), (2, None, None, None, None, None),
            (3, "", "x", 0.0, 0, 0), (None, "BAD!! BAD!!", None, None, None, None), (4, "BAD!! " * 300_000, "y", 1.0, 0, 0)]
    rows += [(10 + i, "calm prose of some length " + "word " * (i % 7) + str(i), "en", 0.0, 0, 0) for i in range(60)]
    rows += [(100 + i, "LOUD!! NOISE!! " * (1 + i % 5), "en", 0.0, 0, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(d, 1 if 10 <= d < 70 else 0, None) for d in [*range(10, 70), *range(100, 160), 999]]
                                   + [(None, 1, 0), (5, None, 0), (10, 1, 0)], "doc_id long, quality int, score string")
    got = quality.op11(docs, labels).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1]) == 2 and by[1][0].score == by[1][1].score
    assert by[2][0].score == by[3][0].score and by[None][0].held_out is False
    assert by[4][0].predicted == 0 and by[None][0].predicted == 0 and by[11][0].predicted == 1
    assert by[1][0].score > by[4][0].score
    assert quality.op11(spark.createDataFrame([], DOCS), labels).count() == 0
    none = labels.where("false")
    assert {r.score for r in quality.op11(docs, none).collect()} == {0.5}
    ones = labels.where("quality = 1")
    assert {r.score for r in quality.op11(docs, ones).collect()} == {1.0}
