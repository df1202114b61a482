"""The conversation trie against brute force, its parentheses against plain scans, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hookline.llm import trie
from hookline.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of the contract; ties of turns go by digest."""
    def digest(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        below = kids.get(s, [])
        leaves[s] = sum(leaves[k] for k in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in below)
    out = []
    for s, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if seqs[c] == s)
        out.append((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), len(kids.get(s, [])), leaves[s], saved[s],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def bushy(seed, n=200):
    """Copies, common beginnings, long shared and long private stretches."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 3 * n), n):
        length = rng.choice([1, 2, 3, 4, 6, 9])
        for t in range(length):
            text = rng.choice(["yes", "no way", "why is that so"]) if rng.random() < 0.8 else f"only {c} {t}"
            rows.append((c, t, "user" if t % 2 == 0 else "bot", text))
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_brute_force(spark, partitions):
    rows = bushy(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards, several spines
    try:
        assert got(trie.op13(spark.createDataFrame(rows, SCHEMA).repartition(partitions))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_table(spark):
    c = table(spark, "/root/testdata/sf0.001", "conversations")
    assert got(trie.op13(c)) == brute([tuple(r) for r in c.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(None, 0, "user", "no conversation"), (20, None, None, None), (20, 3, "user", "b"), (20, None, "user", "a"),
            (21, 5, "user", "tie one"), (21, 5, "bot", "tie two"), (21, 5, "bot", "tie two"), (22, 0, "", ""), (22, 0, None, None),
            (41, 0, "user", "absent base"), (-7, 1, "user", "x y"), (-20, 1, "user", "x y"), (-20, 2, "bot", " \t z z "),
            (60, 0, "user", "W " * 200_000), (61, 0, "user", "W " * 200_000), (63, 9, None, "😀 é")]
    rows += [(500, t, "user", f"endless {t % 3}") for t in range(90)] + [(520, t, "user", f"endless {t % 3}") for t in range(90)]
    rows += [(540, 0, "user", "same")] * 40
    rows += [(c, 0, "user", "hello") for c in range(1000, 1100)]
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 2060) for t in range(3)]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA + ", depth int, path string, n_convs int")
    assert got(trie.op13(df)) == brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(trie, "HOT_SHARE", 1)
    try:
        assert got(trie.op13(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert trie.op13(df.where("false")).count() == 0
    assert trie.op13(df.where("conv_id IS NULL")).count() == 0


def tree_depths(choices):
    """Preorder depths of a tree: each node hangs below one on the way to the last."""
    depth = [0]
    for c in choices:
        depth.append(1 + c % (depth[-1] + 1))
    return np.array(depth)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=500), st.sampled_from([1, 2, 8, 64]))
def test_parentheses_equal_plain_scans(choices, block):
    depth = tree_depths(choices)
    old = trie.Parentheses.BLOCK
    trie.Parentheses.BLOCK = block
    try:
        t = trie.Subtrees(depth)
    finally:
        trie.Parentheses.BLOCK = old
    stack, parent, end, size = [], [], [0] * len(depth), len(depth)
    for i, d in enumerate(depth):
        while len(stack) > d:
            end[stack.pop()] = i
        parent.append(stack[-1] if stack else -1)
        stack.append(i)
    for i in stack:
        end[i] = size
    assert t.end.tolist() == end and t.parents().tolist() == parent
    v = np.arange(1, size + 1)
    assert t.total(v).tolist() == [sum(v[i:end[i]]) for i in range(size)]
    leaf = [end[i] == i + 1 for i in range(size)]
    assert t.leaves(v).tolist() == [sum(int(v[j]) for j in range(i, end[i]) if leaf[j]) for i in range(size)]


def test_a_chain_and_a_star():
    for depth in (np.arange(5000), np.concatenate([[0], np.ones(5000, int)])):
        t = trie.Subtrees(depth)
        assert t.end[0] == len(depth) and t.end[-1] == len(depth)
        assert t.leaves(np.ones(len(depth), int))[0] == (1 if depth[-1] > 1 else 5000)
