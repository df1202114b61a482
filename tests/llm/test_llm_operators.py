"""Training-data operators against brute force, and their defined results on odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hookline.llm import (common, decontaminate, html_text, minhash, neighbours, packing, pii, secrets, substring,
                          toxicity, warc)
from hookline.llm.common import table
SF001 = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, rid long, score double, u long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def odd_documents(spark):
    """Nulls, empties, a very long text, ties and repeated rows, columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards bake bread for the old king of the hill"
    rows = [(1, base), (1, base), (2, base), (3, base + " today"), (None, base), (4, None), (5, ""), (6, " \n\t "),
            (7, "x"), (8, "x"), (9, LONG), (None, None), (10, "Ünïcode 😀 " * 20), (11, LONG)]
    return spark.createDataFrame([(i, t, None, "s", None, 5, 5, 0.5, 5) for i, t in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF001, "documents").cache()


# --- 9: near-dedup ---------------------------------------------------------

def word_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent=80):
    sets = [word_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("odd", [False, True])
def test_minhash_equals_brute_force(spark, docs, odd):
    d = odd_documents(spark) if odd else docs
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.op9(d).collect()]
    want = brute_components([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], 2)
    assert collections.Counter(got) == collections.Counter(want)


def test_minhash_hub_and_rim(spark):
    """Copies of a text that are near it but not near each other are one component; outsiders stay out."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(0, 120, 3), 5 if i < 40 else 14):
            w[at] = f"n{i}_{at}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.op9(d).collect()}
    assert got == set(brute_components(rows, 2))


def test_drop_near_duplicates_keeps_one_row(spark):
    d = odd_documents(spark)
    kept = minhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    ids = sorted((i is None, i or 0) for i, _ in rows)
    assert ids == sorted([(False, i) for i in (1, 4, 5, 6, 7, 9, 10)] + [(True, 0)])
    assert minhash.drop_near_duplicates(no_documents(spark)).count() == 0
    assert minhash.op9(no_documents(spark)).count() == 0


def test_connected_components_on_a_path(spark):
    n = 60
    nodes = list(range(n))
    random.Random(1).shuffle(nodes)
    e = spark.createDataFrame([(nodes[i], nodes[i + 1]) for i in range(n - 1)] + [(200, 201)], "u long, v long")
    got = {r.node: r.root for r in minhash.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(n)}, 200: 200, 201: 200}


# --- 3: packing ------------------------------------------------------------

def check_packing(pieces, rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    want = collections.Counter()
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at, first = 0, len(ids) % 1024 or 1024
        for i, b in enumerate(range(first, len(ids) + 1, 1024)):
            want[(d, i, at, b - at, zlib.crc32(ids[at:b].tobytes()))] += 1
            at = b
    got = collections.Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces)
    assert got == want
    places = collections.defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places), -(-sum(p.length for p in pieces) // 1024)


def test_packing_round_trip(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    used, least = check_packing(packing.op3(docs).collect(), rows)
    assert used <= least + 6


def test_packing_odd_rows(spark):
    d = odd_documents(spark).unionByName(spark.createDataFrame(
        [(20, "a <|endoftext|> b", None, None, None, 0, 0, 0.0, 0)], DOCS))
    check_packing(packing.op3(d).collect(), [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    assert packing.op3(no_documents(spark)).count() == 0


def test_packing_of_very_long_runs_of_white_space(spark):
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a few words"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(dict)
    for r in packing.op3(d).collect():
        got[r.doc_id][r.start] = (r.length, r.ids_crc32)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, packing.SEPARATOR], "<u4")
        assert sum(n for n, _ in got[i].values()) == len(ids)
        assert all(zlib.crc32(ids[a:a + n].tobytes()) == crc for a, (n, crc) in got[i].items())


def test_program_packs_every_piece_near_the_bound():
    rng = np.random.default_rng(0)
    hist = collections.Counter(np.minimum(rng.exponential(300, 20_000).astype(int) + 1, 1024).tolist())
    solution = packing.solve(dict(hist))
    packed = collections.Counter()
    for sizes, n in solution:
        assert n > 0 and sum(sizes) <= 1024
        for s in sizes:
            packed[s] += n
    assert packed == hist
    assert sum(n for _, n in solution) <= 1.003 * sum(k * v for k, v in hist.items()) / 1024 + 3
    assert packing.solve({}) == []
    assert sum(n for _, n in packing.solve({600: 7, 1024: 2})) == 9


def test_knapsack_price_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(3, 30), 5, replace=False))
        most, values = rng.integers(1, 4, 5), rng.random(5)
        a = packing._price(values, sizes, most, 40)
        assert (a <= most).all() and (a * sizes).sum() <= 40
        best = max(float((np.array(c) * values).sum()) for c in np.ndindex(*(most + 1))
                   if (np.array(c) * sizes).sum() <= 40)
        assert (a * values).sum() == pytest.approx(best)


# --- 6: secrets --------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_secrets_base_spans(spark, docs):
    rng = random.Random(2)
    bits = ["password", "Token", "=", ": ", "'", "abcdef", "AKIA", "ABCD1234" * 2, "0a1b2c3d" * 4, " ", "é😀", "api_key",
            "secret", "user", "http://x.org", "abc", "=abc=password=", "k" * 20 + "A1" * 10]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(300)]
    d = spark.createDataFrame([(i, t, None, None, None, 0, 0, 0.0, 0) for i, t in rows], DOCS).unionByName(
        odd_documents(spark))
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)
                              for r in secrets.op6(d).collect())
    want = collections.Counter()
    for i, t in rows:
        b = brute_secrets(t)
        want[(i, *[sum(x.startswith(k) for x in b) for k in ("assign", "access", "hex")],
              hashlib.sha256(",".join(b).encode()).hexdigest())] += 1
    assert got == want
    assert secrets.op6(no_documents(spark)).count() == 0


def test_hosts_of_any_length_are_endpoints(spark):
    host = "a1-" * 400 + "bucket.s3.amazonaws.com"
    d = spark.createDataFrame([(1, f"password: hunter22 at {host} end"), (2, "x" * 200_000 + " user: a.b"), (3, "a." * 200_000)],
                              "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.op6(d).collect()}
    at = len("password: hunter22 at ")
    assert f"endpoint:{at}:{at + len(host)}" in spans[1] and spans[2] == spans[3] == ""


def test_weak_parts_need_a_partner(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY0z"
    assert len(key) == 40
    rows = [(1, f"blob {key} end"), (2, f"id AKIA{'Q' * 16} then {key}"), (3, "see http://example.org/x for more"),
            (4, "http://example.org/x password = hunter22"), (5, f"AKIA{'Q' * 16} {'pad ' * 200}{key}"),
            (6, f"{key} " + "x" * 100 + " https://a.b/c")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(d).collect()}
    assert kinds == {1: [], 2: ["access", "key"], 3: [], 4: ["endpoint", "assign"], 5: ["access"],
                     6: ["key", "endpoint"]}
    assert sorted(r.doc_id for r in secrets.drop_secrets(d).collect()) == [1, 3]


def test_drop_secrets_keeps_columns(spark):
    d = odd_documents(spark)
    kept = secrets.drop_secrets(d)
    assert kept.columns == d.columns and kept.count() == d.count()


# --- 8: decontamination --------------------------------------------------------

def test_leaks_in_table(spark, docs):
    bench = table(spark, SF001, "benchmark")

    def words(t):
        return " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in words(r.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert want and want <= got
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_near_leaks_and_odd_rows(spark):
    item = " ".join(f"item{i}" for i in range(60))
    near = item.replace("item30 ", "other ")  # 50 of 60 shingles
    far = item.replace("item15 ", "a ").replace("item30 ", "b ").replace("item45 ", "c ")
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (3, "", 0), (4, "two words", 0), (None, "Zz9 q", 0)],
                                  "item_id long, text string, doc_id long")
    rows = [(1, "lead " * 40 + item.upper() + " tail" * 9), (2, "x " + near), (3, far), (4, "some two   WORDS here"),
            (5, "item0 item1 item2 item3 item4"), (6, None), (7, ""), (8, "zz9, q"), (None, item), (9, LONG)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 4), (8, None), (None, 1)}
    kept = [r.doc_id for r in decontaminate.drop_contaminated(d, bench).collect()]
    assert sorted(kept) == [3, 5, 6, 7, 9]
    none = bench.limit(0)
    assert decontaminate.find_leaks(d, none).count() == 0
    assert decontaminate.drop_contaminated(d, none).count() == len(rows)
    assert decontaminate.find_leaks(d.limit(0), bench).count() == 0


def test_leaks_of_items_that_share_a_template(spark):
    template = " ".join(f"t{i}" for i in range(104))
    bench = spark.createDataFrame([(i, f"{template} unique{i}") for i in range(300)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"{template} other")], "doc_id long, text string")
    got = decontaminate.find_leaks(d, bench).collect()
    # 100 shingles of weight log 2 shared, one of weight log 301 on either side: similarity 0.86
    assert {r.item_id for r in got} == set(range(300))
    assert all(r.similarity == pytest.approx(100 * np.log(2) / (100 * np.log(2) + 2 * np.log(301))) for r in got)


def test_leaks_do_not_depend_on_item_blocks(spark, monkeypatch):
    """Similarities follow the whole benchmark, and equal a plain weighted Jaccard over all aligned windows."""
    rng = random.Random(21)
    template = prose(rng, 14)
    items = [(i, f"{template} {prose(rng, 16)}") for i in range(60)]
    docs = []
    for i, t in items[:30]:
        w = t.split()
        for at in rng.sample(range(14, 30), i % 4):
            w[at] = prose(rng, 1)
        docs.append((i, f"{prose(rng, 20)} {' '.join(w)} {prose(rng, 10)}"))
    d, b = (spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id")))
    found = []
    for size in (20_000, 7):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", size)
        found.append(sorted((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in decontaminate.find_leaks(d, b).collect()))
    assert found[0] == found[1] and len(found[0]) >= 8

    def bag(words):
        return collections.Counter(zip(*[words[i:] for i in range(5)]))
    df = collections.Counter(s for _, t in items for s in set(bag(t.lower().split())))
    weight = (lambda s: np.log1p(60 / max(df[s], 1)))
    want = set()
    for i, t in docs:
        w = t.lower().split()
        for j, item in items:
            y = bag(item.lower().split())
            for a in range(len(w) - 30 + 1):
                x = bag(w[a:a + 30])
                sim = sum(min(x[s], y[s]) * weight(s) for s in x) / sum(max(x[s], y[s]) * weight(s) for s in x | y)
                if sim >= 0.8:
                    want.add((i, j))
    assert {(i, j) for i, j, _, _ in found[0]} == want


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    a = rng.random((50, decontaminate.BITS)) < 0.5
    n = np.full(50, 9)
    for flips in (0, 12, decontaminate.RADIUS):
        b = a.copy()
        for i in range(50):
            b[i, rng.choice(decontaminate.BITS, flips, replace=False)] ^= True
        assert (decontaminate._block_keys(a, n) == decontaminate._block_keys(b, n)).any(1).all()


# --- 10: toxicity ----------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = SF001.replace("0.001", "0.1")
    labels = table(spark, sf, "labels")
    r = toxicity.op10(table(spark, sf, "documents"), labels).join(labels, "doc_id").toPandas()
    assert all(((zlib.crc32(str(i).encode()) % 5) == 0) == h for i, h in zip(r.doc_id, r.held_out))
    held = r[r.held_out]
    y, s = held.toxic.to_numpy(), held.score.rank().to_numpy()
    auc = (s[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.97
    assert ((held.predicted == 1) == (held.score >= 0.5)).all() and held.score.between(0, 1).all()
    assert (held.predicted[y == 0] == 0).mean() > 0.99 and (held.predicted[y == 1] == 1).mean() > 0.85


def test_toxicity_ignores_held_out_labels(spark, docs):
    from pyspark.sql import functions as F
    labels = table(spark, SF001, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.op10(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_odd_rows(spark):
    d = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.op10(d, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    r = toxicity.op10(d, some).collect()
    assert len(r) == d.count() and all(0 <= x.score <= 1 for x in r)
    assert toxicity.op10(no_documents(spark), some).count() == 0
    model = toxicity.fit(d, none)
    assert toxicity.drop_toxic(d, model).columns == d.columns and toxicity.drop_toxic(d, model).count() == d.count()


def test_isotonic_is_monotone_mean():
    x, y = toxicity.fit_isotonic(np.array([1., 2, 3, 4]), np.array([0., 1, 0, 1]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


# --- 4: personal data --------------------------------------------------------------

PATTERNS = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"),
            re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_pii(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            n = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(g) <= 255 for g in m[0].split(".")) or k == 3 and 8 <= len(n) <= 15
                    or k == 2 and 16 <= len(n) <= 19 and pii.luhn(n)):
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("aZ09.1@+-% ( )_é4242\n") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == brute_pii(t), t
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" * 50_000, "1.2." * 50_000):
        pii.base_spans(t)  # linear


def test_pii_over_documents(spark, docs):
    d = docs.select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = pii.op4(d).collect()
    want = collections.Counter()
    for i, t in rows:
        b = brute_pii(t)
        s = ",".join(f"{pii.KINDS[k]}:{x}:{y}" for k, x, y in b)
        want[(i, *[sum(k == j for k, *_ in b) for j in range(4)], hashlib.sha256(s.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(",".join(f"{pii.KINDS[k]}:{x}:{y}" for k, x, y in brute_pii(t)))
    assert all(any(set(filter(None, b.split(","))) <= set(r.spans.split(",")) for b in texts[r.doc_id]) for r in got)
    assert pii.op4(no_documents(spark)).count() == 0
    assert {r.spans for r in pii.op4(spark.createDataFrame([(1, None), (2, "no data")], "doc_id long, text string")).collect()} == {""}


def test_crf_gradients():
    rng = np.random.default_rng(0)
    s, tags, trans = rng.normal(size=(5, 2, 3)), rng.integers(0, 3, (5, 2)), rng.normal(size=(3, 3))
    _, ds, dt = pii._crf_loss(s, tags, trans)
    for a, g, i in ((s, ds, (2, 1, 0)), (trans, dt, (1, 2))):
        old = a[i]
        a[i] = old + 1e-5
        up = pii._crf_loss(s, tags, trans)[0]
        a[i] = old - 1e-5
        down = pii._crf_loss(s, tags, trans)[0]
        a[i] = old
        assert (up - down) / 2e-5 == pytest.approx(g[i], abs=1e-6)


def test_tagger_learns_spans():
    rng = random.Random(7)

    def words(n):
        return " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [f"{words(12)} {words(1).replace(' ', '')}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com {words(9)} "
             f"{'.'.join(str(rng.randint(1, 255)) for _ in range(4))} {words(30)} {rng.randint(1, 999)} {words(10)}"
             for _ in range(150)]
    x, y = pii.training_windows(texts[:100])
    model = pii.fit(x, y)
    found = pii.tagged_spans(model, texts[100:], [[] for _ in texts[100:]])
    want = [pii.base_spans(t) for t in texts[100:]]
    hit = sum(any(k == kk and a < yy and xx < b for kk, xx, yy in f) for f, w in zip(found, want) for k, a, b in w)
    assert hit >= 0.8 * sum(map(len, want))


def test_disguised_emails_without_digits_are_found(spark):
    rng = random.Random(6)
    names = ["anna", "john", "maria.lopez", "peter", "kate.smith", "bernadette.featherstonehaugh"]
    docs = [(i, f"{prose(rng, 30)} {rng.choice(names)}@{prose(rng, 1, 4)}.com {prose(rng, 30)}") for i in range(300)]
    want = {}
    for i in range(300, 340):
        left, span = prose(rng, 40), f"{rng.choice(names)} (at) {prose(rng, 1, 4)} (dot) com"
        docs.append((i, f"{left} {span} {prose(rng, 40)}"))
        want[i] = (len(left) + 1, len(left) + 1 + len(span))
    got = {r.doc_id: r.spans for r in pii.op4(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {i: [tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x.startswith("email")] for i in want}
    hit = sum(any(a < y and x < b for x, y in found[i]) for i, (a, b) in want.items())
    assert hit >= 0.8 * len(want)


def test_windows_cover_marks_and_the_words_beside_them():
    for left in ("", "x " * 50):
        for span in ("john (at) example (dot) com", "john [AT] example.com", "john at example dot com",
                     "a" * 60 + " (at) " + "b" * 60 + " (dot) com", "firstname.middlename.lastname @ example.com", "x7"):
            for right in ("", " y" * 50):
                text = left + span + right
                seen = np.zeros(len(text) + pii.SIZE, bool)
                for a in pii._windows(text).tolist():
                    seen[a:a + pii.SIZE] = True
                assert seen[len(left):len(left) + len(span)].all(), text
    assert len(pii._windows("no data in this text, but that dotted attic")) == 0


# --- 5: substring dedup ----------------------------------------------------------

def test_repeated_passages_are_found(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = (t or "").split(" ")
        for j in range(len(w) - 50):
            if len(set(w[j:j + 51])) > 10:
                seen[tuple(w[j:j + 51])].add(i)
    want = {i for v in seen.values() if len(v) > 1 for i in v}
    runs = substring.op5(docs).collect()
    got = {r.doc_id for r in runs}
    assert want and want <= got
    texts = dict(rows)
    for r in runs:
        assert 0 <= r.start < r.end <= len(texts[r.doc_id])
        piece = texts[r.doc_id][r.start:r.end].encode()
        assert len(piece) == r.bytes
        # every chunk of what is reported stands in the first document, which comes before a copy
        whole, at = texts[r.doc_id].encode(), len(texts[r.doc_id][:r.start].encode())
        ends, _ = substring.cuts_of(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
        ends = [e for e in ends.tolist() if at < e <= at + r.bytes]
        assert len(ends) == r.chunks and ends[-1] == at + r.bytes
        assert all(whole[a:b] in texts[r.first_doc_id].encode() for a, b in zip([at, *ends], ends))
        assert r.first_doc_id == r.doc_id if r.is_first else r.first_doc_id < r.doc_id


def test_chunks_resist_insertions_and_cover_texts():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeéü😀") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    for t in (text, "x" + text, "of " * 5000, "", "é" * 1000):
        buf = np.frombuffer(t.encode(), np.uint8)
        ends, _ = substring.cuts_of(buf, np.array([0, len(buf)]))
        parts = [t.encode()[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        assert b"".join(parts) == t.encode()
        assert all(p.decode() is not None and len(p) <= substring.MAX_CHUNK + 4 for p in parts)
        if t == text:
            first = set(parts)
        elif t == "x" + text:
            assert len(first - set(parts)) <= 3


def test_substring_odd_rows_and_removal(spark):
    d = odd_documents(spark)
    got = collections.Counter(r.doc_id for r in substring.op5(d).collect())
    assert got[9] == 1 and got[11] == 1 and 4 not in got and 5 not in got
    out = substring.drop_repeats(d)
    assert out.columns == d.columns and out.count() == d.count()
    texts = collections.Counter(len(r.text or "") for r in out.where("doc_id in (9, 11)").collect())
    assert sorted(texts) == [0, len(LONG)]
    assert substring.op5(no_documents(spark)).count() == 0


def prose(rng, n, low=2, high=9):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))
                    for _ in range(n))


def test_chunks_of_a_row_do_not_depend_on_its_neighbours():
    rng = random.Random(5)
    for n in (0, 1, 5, 31, 32, 33, 100, 120, 140, 200, 900):
        text = prose(rng, 200)[:n].encode()
        alone, _ = substring.cuts_of(np.frombuffer(text, np.uint8), np.array([0, n]))
        for _ in range(20):
            before, after = prose(rng, rng.randint(1, 40)).encode(), prose(rng, rng.randint(1, 40)).encode()
            buf = np.frombuffer(before + text + after, np.uint8)
            ends, rows = substring.cuts_of(buf, np.array([0, len(before), len(before) + n, len(buf)]))
            assert (ends[rows == 1] - len(before)).tolist() == alone.tolist()


def test_a_first_occurrence_beside_a_copy_stays(spark):
    rng = random.Random(8)
    x, a, y = (prose(rng, 80) for _ in range(3))
    d = spark.createDataFrame([(1, a), (2, f"{x} {a} {y}"), (3, f"{x} {a} {y}")], "doc_id long, text string").coalesce(1)
    runs = substring.op5(d).collect()
    assert {(r.doc_id, r.first_doc_id, r.is_first) for r in runs} == {
        (1, 1, True), (2, 2, True), (2, 1, False), (3, 2, False), (3, 1, False)}
    texts = {r.doc_id: r.text for r in substring.drop_repeats(d).collect()}
    assert texts[1] == a and texts[3] == ""
    # row 2 keeps what stands nowhere before; of the copy only its ends, less than a few chunks, may stay
    assert x in texts[2] and y in texts[2]
    assert len(x) + len(y) <= len(texts[2]) < len(x) + len(y) + 2 * substring.MAX_CHUNK


def test_a_short_copy_between_first_occurrences_stays(spark):
    """Row 2 holds a short phrase of row 1 between texts of its own, row 3 copies row 2: of row 2 nothing goes."""
    rng = random.Random(11)
    rows = []
    for g in range(40):
        phrase = prose(rng, 40)[:85]
        middle = f"{prose(rng, 60)} {phrase} {prose(rng, 60)}"
        rows += [(3 * g, f"{prose(rng, 5)} {phrase} {prose(rng, 5)}"), (3 * g + 1, middle), (3 * g + 2, middle)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    runs = substring.op5(d).collect()
    assert not [r for r in runs if r.doc_id % 3 == 1 and not r.is_first]
    left = {r.doc_id: r.text for r in substring.drop_repeats(d).collect()}
    assert all(left[i] == t for i, t in rows if i % 3 < 2)
    assert all(left[i] == "" for i, _ in rows if i % 3 == 2)
    # another layout of the files, the same result
    again = substring.op5(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)).collect()
    assert collections.Counter(again) == collections.Counter(runs)


# --- 7: neighbours -----------------------------------------------------------------

def brute_neighbours(rows, q, top=10):
    x = dict(rows)
    d = sorted((float(np.sqrt(((np.array(v) - np.array(x[q])) ** 2).sum())), i) for i, v in rows if i != q)
    return d[:top]


@pytest.mark.parametrize("spread", [0.0, 0.6])
def test_neighbours_recall(spark, spread):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= np.exp(rng.normal(0, spread, (1500, 1)))
    v[300:700] = v[299]  # a vector that very many rows share
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in neighbours.op7(d).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    assert set(found) == set(range(0, 1500, 100))
    hit = 0
    for q, got in found.items():
        assert len(got) == 10 and got == sorted(got)
        want = brute_neighbours(rows, q)
        hit += len({i for _, i in want} & {i for _, i in got})
        if 300 <= q < 700:
            assert [i for _, i in got] == [i for _, i in want]
        x = dict(rows)
        for s, i in got:
            assert s == pytest.approx(float(np.linalg.norm(np.array(x[i]) - np.array(x[q]))), abs=1e-9)
    assert hit >= 0.9 * 10 * len(found)


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, None),
            (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [1.0, 2.0]),
            (None, [1.0, 0.0, 0.1]), (100, [0.0, 0.0, -2.0]), (200, [float("inf"), 0.0, 0.0])]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id long, v long")
    got = collections.defaultdict(list)
    for r in neighbours.op7(d).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == {0: [2, 1, 100], 100: [0, 1, 2]}
    assert neighbours.op7(d.limit(0)).count() == 0


def test_neighbours_in_split_buckets(spark, monkeypatch):
    """Blocks of vectors and parts of queries change nothing of the result."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 6)) + np.array([5, 0, 0, 0, 0, 0])   # most fall into a few buckets
    x = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "id long, v array<double>")
    found = []
    for size in (4096, 16):
        monkeypatch.setattr(neighbours, "BLOCK", size)
        found.append(sorted(tuple(r) for r in neighbours.search(x, x.where("id % 4 = 0"), 5).collect()))
    assert found[0] == found[1] and len(found[0]) == 500


def test_neighbours_of_very_wide_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(24, 40_000))
    rows = [(i, r) for i, r in enumerate(v.tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in neighbours.op7(d).orderBy("rank").collect()]
    want = brute_neighbours(rows, 0)
    assert [i for i, _ in got] == [i for _, i in want]
    assert all(s == pytest.approx(d) for (_, s), (d, _) in zip(got, want))


def test_neighbours_of_every_vector_size(spark):
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(301, 8)))]
    rows += [(i, v.tolist()) for i, v in zip(range(1000, 1031), rng.normal(size=(31, 5)))]
    rows += [(-1, [1.0, 2.0, 3.0]), (2000, [1.0]), (200, [1.0, 2.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.op7(d).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 1000}
    assert all([r for r, _, _ in x] == list(range(1, 11)) for x in got.values())
    assert {i for _, i, _ in got[1000]} <= set(range(1001, 1031))
    assert got[200][0][1:] == (-1, 1.0)
    x = dict(rows[:301])
    want = brute_neighbours(rows[:301], 0)
    assert len({i for _, i in want} & {i for _, i, _ in got[0]}) >= 9
    assert all(s == pytest.approx(float(np.linalg.norm(np.array(x[i]) - np.array(x[0])))) for _, i, s in got[0])


# --- 1: WARC -------------------------------------------------------------------------

def odd_pages(spark):
    rows = [(1, "http://a.b/x", "<p>same</p>"), (2, "http://a.b/ü y\r\nX: 1", "<p>same</p>"), (2, None, "<p>same</p>"),
            (3, None, None), (4, "", ""), (None, "http://c", "<p>same</p>"), (5, "u", "é" * 150_000), (6, "u", "\r\n\r\nWARC/1.1"),
            (7, "u", "é" * 150_000)]
    return spark.createDataFrame([(i, u, h, 1, 2) for i, u, h in rows],
                                 "page_id long, url string, html string, record long, chunk long")


def test_warc_round_trip(spark):
    pages = odd_pages(spark)
    folder, manifest = warc.write_archives(pages)
    back = warc.read_archives(folder, manifest).collect()
    whole = collections.defaultdict(dict)
    for r in back:
        whole[r.record][r.chunk] = r
    payload = {}
    for rec, chunks in whole.items():
        assert sorted(chunks) == list(range(len(chunks)))
        assert all(len(c.data or b"") <= warc.CHUNK for c in chunks.values())
        if chunks[0].record_type == "response":
            data = b"".join(chunks[i].data for i in sorted(chunks))
            payload[rec] = data
            done = b""
            for i in sorted(chunks):
                done += chunks[i].data
                assert chunks[i].bytes_so_far == len(done)
                assert chunks[i].digest_so_far == base64.b32encode(hashlib.sha1(done).digest()).decode()
    assert len(whole) == 9
    assert set(payload.values()) == {b"<p>same</p>", b"", ("é" * 150_000).encode(), b"\r\n\r\nWARC/1.1"}
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op1(pages).collect())
    assert got == collections.Counter([
        (1, 11, "revisit", 2), (2, 11, "response", None), (2, 11, "revisit", 2), (None, 11, "revisit", 2),
        (3, 0, "revisit", 4), (4, 0, "response", None), (5, 300_000, "revisit", 7), (7, 300_000, "response", None),
        (6, 12, "response", None)])
    assert all(r.record_type == "response" or r.payload_bytes >= 100 for r in warc.read_archives(
        *warc.write_archives(pages, min_revisit=100), with_data=False).collect()
        for r in [type("R", (), {"record_type": r.record_type, "payload_bytes": r.bytes_so_far})])


def test_warc_of_long_urls(spark):
    """Urls of megabytes, over payloads of one chunk and of many; a revisit leaves its payload behind."""
    url, big = "https://a.example/" + "é" * 700_000, "<p>" + "x" * 300_000
    rows = [(1, url, "<p>short"), (2, url + "2", big), (3, "https://b.example", big), (4, None, "")]
    got = {r.page_id: r for r in warc.op1(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {
        1: ("response", None, 8), 2: ("revisit", 3, len(big)), 3: ("response", None, len(big)), 4: ("response", None, 0)}
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
               for (i, _, h) in rows for r in [got[i]])


def test_warc_table_and_empty(spark):
    pages = table(spark, SF001, "pages")
    want = {(r.page_id, len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode())
            for r in pages.collect()}
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.op1(pages).collect()} == want
    assert warc.op1(odd_pages(spark).limit(0)).count() == 0


# --- 2: HTML ---------------------------------------------------------------------------

def text_of(page):
    return " ".join(b[2] for b in html_text.parse(page)[0])


def test_html_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article class="post"><header><h1>Title &amp; more</h1><div class="byline">By X</div></header><p>One <b>bo</b>ld&nbsp;text
    and <a href=x>a link</a>.<br>Next<p>Two &lt;3 <!-- no <p>no</p> -->end<ul><li>a<li>b</ul><div class="ad">Buy</div>
    <form><input value=x><button>Go</button></form><section id="comments"><p>First!</p></section></article>
    <aside>Side</aside><footer>&copy; me"""
    assert text_of(page) == "Title & more One bold text and a link . Next Two <3 end a b".replace(" .", ".")
    assert text_of("") == "" and text_of("plain words") == "plain words"
    assert text_of("<p>kept <a hre") == "kept"
    assert text_of("<p>a < b</p>") == "a < b"
    assert text_of("<div><p>x" * 3000) .startswith("x x")
    assert text_of("<script>never closed <p>no") == ""
    assert text_of("<!-- open <p>no") == ""


def test_html_names_tell_content_from_frame():
    for wrap in ('class="site-content no-sidebar"', 'id="page" class="has-header layout"', 'class="with-comments"',
                 'class="sidebar-wrapper"', 'class="related-work"'):
        assert text_of(f"<body><div {wrap}><p>The story.</p></div></body>") == "The story.", wrap
    for wrap in ("sidebar", "site-footer", "main-nav", "cookie-notice", "page-header", "user-comment", "commentList", "adBox", "social-links"):
        assert text_of(f"<body><div class='{wrap}'><p>no</p></div><div class=post><p>The story.</p></div></body>") == "The story.", wrap
    assert text_of("<div class='comments'><p>all there is is comments</p></div>") == ""
    assert text_of("<div class=post><h2>Related work</h2><div class='related-work'><p>A study.</p></div></div>") == "Related work A study."


def test_html_inline_noise():
    assert text_of("<p>a <a class='advert' href=x>Buy</a><span class=ad>now</span> b</p>") == "a b"
    assert text_of("<p>a <span hidden>x <span>y</span> z</span> b</p><p>c</p>") == "a b c"
    assert text_of("<div>a <span hidden><div>x</div> z</span> b</div>") == "a b"
    assert text_of("<p>a <i hidden>never closed <p>next") == "a next"
    assert text_of("<p>code <span class='comment'># stays</span> <a href='?id=3&class=4'>l</a>") == "code # stays l"
    story = "<div class=post><p>" + "The long story goes on. " * 20 + "</p></div>"
    assert "story" in text_of(story + "<article><h3>Teaser</h3></article>")
    assert text_of(story + "<main><p>" + "main text " * 60 + "</p></main>") == ("main text " * 60).strip()
    assert text_of("<article><p>Told.</p></article><article class='user-comment'><p>no</p></article>") == "Told."


def test_html_deep_nesting_keeps_marks():
    page = "<div>" * 420 + "<nav><p>no</p></nav><div class=comments><p>no</p></div><p>yes</p>" + "</div>" * 420 + "<p>end</p>"
    assert text_of(page) == "yes end"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<i hidden>" * 100_000, "<!" * 500_000, "<a '" * 250_000, "</script " * 110_000,
                                  "<div>" * 200_000, "<div><li></li>" * 70_000, "<script>" + "</script " * 110_000,
                                  "<div>" * 100_000 + "</p>" * 100_000, '<a href="' * 110_000 + "'", "<b>" * 300_000 + "</b>" * 10])
def test_html_scan_is_linear(page):
    import time
    t = time.process_time()
    html_text.parse(page)
    assert time.process_time() - t < 5


def test_html_table(spark):
    pages = table(spark, SF001, "pages")
    import html as H
    for r in html_text.op2(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(H.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


def test_site_frame_is_removed_by_its_entropy(spark):
    """Blocks that every page of a site repeats go, though nothing in the markup says so."""
    rng = random.Random(0)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(20):
        t = words(30)
        rows.append((i, f"http://site.org/{i}", f"<body><div class=x1><p>Welcome to our site</p></div><div class=x2><p>{t}</p></div></body>"))
        want[i] = t
    for i in range(20, 23):  # a small host says nothing about its frame
        rows.append((i, f"http://small.org/{i}", "<body><div class=x1><p>Welcome</p></div></body>"))
        want[i] = "Welcome"
    rows += [(30, None, None), (31, "no url", ""), (30, None, None)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text long")
    got = collections.defaultdict(list)
    for r in html_text.op2(d).collect():
        got[r.page_id].append(r.text)
    assert all(got[i] == [t] for i, t in want.items())
    assert got[30] == ["", ""] and got[31] == [""]
    assert html_text.op2(d.limit(0)).count() == 0


def test_frame_of_a_host_with_a_small_share_of_the_pages(spark, monkeypatch):
    """A host's name is text, and only a host with over 1/1000 of the rows is broadcast."""
    rng = random.Random(4)
    monkeypatch.setattr(common, "HOT_SHARE", 2)   # the larger host is hot, the others are not
    own = [prose(rng, 30) for _ in range(90)]
    host = ["large.org"] * 60 + ["small.org"] * 20 + ["other.org"] * 10
    rows = [(i, f"http://{h}/{i}", f"<body><div class=x1><p>Welcome to {h}</p></div><div class=x2><p>{own[i]}</p></div></body>")
            for i, h in enumerate(host)]
    rows.append((90, None, None))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.op2(d).collect()} == dict(enumerate([*own, ""]))


@pytest.mark.parametrize("kind", ["string", "long", "date"])
def test_skewed_join_on_keys_of_any_type(spark, kind):
    n = 4000   # two keys above 1/1000 of the rows, many below, a null one and one that the other side lacks
    key = F.when(F.col("id") < 2000, 10).when(F.col("id") < 3900, 11).when(F.col("id") < 3990, F.col("id") % 40 + 12).when(
        F.col("id") < 3995, 99)
    typed = {"string": F.concat(F.lit("k"), key.cast("string")), "long": key.cast("long"), "date": F.date_add(F.lit("2020-01-01"), key.cast("int"))}[kind]
    big = spark.range(n).select("id", typed.alias("k"))
    small = big.where("id < 3990").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for how in ("left", "inner"):
        want = sorted(map(tuple, big.join(small, "k", how).select("id", "k", "n", "top").collect()))
        got = common.join_skewed(big, small, "k", "n", n, "id", how)
        assert sorted(map(tuple, got.collect())) == want and got.columns == ["id", "k", "n", "top"]


def test_near_copies_of_a_page_keep_their_text(spark):
    rng = random.Random(9)

    def page(paras, frame="", wrap="article"):
        return f"<html><body>{frame}<{wrap}>{''.join(f'<p>{p}</p>' for p in paras)}</{wrap}></body></html>"

    def copies(host, n, paras, **more):
        out = []
        for i in range(n):
            own = list(paras)
            own[rng.randrange(len(own))] = f"counter {prose(rng, 3)}"
            out.append((f"http://{host}/{i}", page(own, **more), own, more.get("frame")))
        return out
    frame = f"<div class='bar'><p>{prose(rng, 6)}</p><p>{prose(rng, 6)}</p></div>"
    article = [prose(rng, 12) for _ in range(20)]
    rows = copies("copies.example", 8, article) + copies("many.example", 90, article, frame=frame, wrap="div")
    for i in range(12):
        own = [prose(rng, 12) for _ in range(20)]
        rows.append((f"http://many.example/u{i}", page(own, frame, "div"), own, frame))
    d = spark.createDataFrame([(i, u, h) for i, (u, h, _, _) in enumerate(rows)], "page_id long, url string, html string")
    for r in html_text.op2(d).collect():
        _, _, own, bar = rows[r.page_id]
        assert all(p in r.text for p in own), r.url
        for p in re.findall("<p>(.*?)</p>", bar or ""):
            assert p not in r.text


# --- pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "pack"]
    d = docs
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, d, SF001)
        assert kept.columns == d.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        if name == "near_dedup":
            assert ids == {i for i, n, c in brute_components(rows, 5) if i == c}
        if name == "secrets":
            assert not any(brute_secrets(t) for i, t in rows if i in ids)
            assert all(brute_secrets(t) for i, t in rows if i not in ids)
        d = kept
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    from hookline.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    pieces = cp.run(spark, SF001).collect()
    check_packing(pieces, rows)
    left = [x for x in os.listdir(folder) if x not in before and not x.startswith(".")]
    assert len(left) == 1 and left[0].startswith("hookline-pipeline-pack-")
