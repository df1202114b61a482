"""Fill-in-middle transformation against a plain version, and its index against all offsets."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hookline.llm import infill
from hookline.llm.common import table

SF001 = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    w = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(w), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(w), form, len(pre), len(mid), sha(out), sha(text)


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_equals_plain_version(spark):
    docs = table(spark, SF001, "documents")
    want = [brute(r.doc_id, r.text) for r in docs.collect()]
    got = infill.op12(docs).collect()
    assert order(got) == order(want)
    assert {r[2] for r in want} == {"plain", "spm", "psm"}


def test_odd_rows(spark):
    texts = [None, "", " ", "\t\r\n\v\f ", "a", " a", "a ", "<P>", "x <S> y", "a <M", "<", "<P <S <M <<P", "😀 é b  c\x1cd ",
             "S> P> <", "x" * 400_000 + " y " * 50_000, "word " * 200_000, "\x00 a\x00"]
    rows = [(i + 100 * k if i else None, t, 5, "n", 1) for k in range(12) for i, t in enumerate(texts)] + [(7, "same row", 5, "n", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string, segments long")
    got = infill.op12(docs).collect()
    assert order(got) == order([brute(d, t) for d, t, *_ in rows])
    assert infill.op12(docs.where("false")).count() == 0


def test_output_holds_the_text(spark):
    docs = table(spark, SF001, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in infill.infill(docs).collect():
        if r.form != "plain":
            assert len(r.output) == len(text[r.doc_id]) + 9 and 1 <= r.segments <= r.n + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 12), st.integers(0, 100_000)), max_size=900), st.sampled_from([0, 1, 8, 126]))
def test_index_gives_every_offset(steps, error):
    o = np.concatenate([[0], np.cumsum(np.array(steps, np.int64))]).astype(np.int64)
    index = infill.RankIndex(o, error)
    assert [index[k] for k in range(len(o))] == o.tolist()
    assert np.abs(index.residual.astype(int)).max() <= error + 1


def test_a_straight_text_needs_one_segment():
    o = np.arange(0, 500_000, 5)
    assert len(infill.RankIndex(o).first) == 1
    bend = np.concatenate([o, o[-1] + np.arange(1, 90_000) * 11])
    assert len(infill.RankIndex(bend).first) == 2
