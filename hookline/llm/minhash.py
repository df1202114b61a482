"""MinHash near-dedup (operator 9).

Universal hash minima, banding, signature verification, exact verification on
full shingle sets and connected components by alternating large-star and
small-star.

1. One pass over the texts writes, per row, the number of distinct shingles, a
   128-bit fingerprint of the set, 128 minima and 32 band keys of four minima.
   A pair at similarity 0.8 shares no band with probability 5e-8.
2. Rows with equal sets are one class from here on; a group of copies is one
   vertex whatever its size.
3. In each band bucket the class with the most bucket mates overall leads
   (in a group of near copies that is the text they were copied from). Members
   are compared with their leaders: signatures first, then full sets.
4. Clusters (the members that share a leader) which still lie in several
   components are completed: outsiders meet all members in blocks of bounded
   size. What a pair can share is bounded by what each shares with the leader
   plus the common rest, so only pairs that may reach the similarity and join
   two components leave a block; none of those is left out.
5. Components are labelled by large-star / small-star on written edge tables.

Rows: a null or blank text has an empty set and links with nothing. Repeated
rows (or ids) are rows of their own that link as copies. A null ``doc_id``
takes part; its component's id is the smallest non-null one reachable, null if
there is none. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ROW, ascii_lower, join_skewed, materialise, mix, numbered, prefix_hashes,
                     shingle_hashes, slices, span_hash, utf8, with_columns_of, word_spans)

N_MINIMA, ROWS_PER_BAND = 128, 4
BLOCK = 256
#: Signatures whose estimate falls this far below the threshold are not verified
#: (over six standard deviations at 128 minima and similarity 0.8).
MARGIN = 0.22

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, N_MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, N_MINIMA, dtype=np.uint64)


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of all rows end to end, and n + 1 offsets."""
    buf, off = utf8(col)
    low = ascii_lower(buf)
    start, end, row = word_spans(low, off)
    h, hrow = shingle_hashes(span_hash(prefix_hashes(low), start, end), row, k)
    cut = np.searchsorted(hrow, np.arange(len(off)))
    sets = [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    offsets = np.zeros(len(off), np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else h), offsets


def set_prints(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: together its fingerprint."""
    def sums(v):
        c = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=c[1:])
        return c[off[1:]] - c[off[:-1]]
    return (sums(mix(flat + np.uint64(0x1234567))).view(np.int64),
            sums(mix(flat ^ np.uint64(0xABCDEF0123456789))).view(np.int64))


def signatures(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, N_MINIMA) upper halves of the minima of (a x + b) mod 2^64; zeros for empty sets."""
    n = np.diff(off)
    out = np.zeros((len(n), N_MINIMA), np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        at = off[:-1][full]
        for j in range(N_MINIMA):
            out[full, j] = np.minimum.reduceat(flat * _A[j] + _B[j], at) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, bands) 64-bit keys of consecutive groups of ROWS_PER_BAND minima."""
    b = sig.reshape(len(sig), -1, ROWS_PER_BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(b.shape[1], dtype=np.uint64), b.shape[:2]).copy()
    for j in range(ROWS_PER_BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + b[:, :, j])
    return key.view(np.int64)


def _sketch(k: int):
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()),
                        ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                flat, off = shingle_sets(part.column("text"), k)
                sig = signatures(flat, off)
                f1, f2 = set_prints(flat, off)
                keys = band_keys(sig)
                nb = keys.shape[1]
                bands = pa.ListArray.from_arrays(
                    np.arange(0, nb * len(sig) + 1, nb, dtype=np.int32), keys.reshape(-1))
                sigs = pa.Array.from_buffers(pa.binary(N_MINIMA * 4), len(sig),
                                             [None, pa.py_buffer(np.ascontiguousarray(sig))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), part.column("row_key"), pa.array(np.diff(off)),
                     pa.array(f1), pa.array(f2), sigs.cast(pa.binary()), bands], schema=schema)
    return run


def _sets(k: int):
    """Rows (rid, f1, f2, text) -> (rid, shingles), dropping a row whose set is another."""
    schema = pa.schema([("rid", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                flat, off = shingle_sets(part.column("text"), k)
                f1, f2 = set_prints(flat, off)
                same = (f1 == part.column("f1").to_numpy()) & (f2 == part.column("f2").to_numpy())
                lists = pa.ListArray.from_arrays(off.astype(np.int32), flat.view(np.int64))
                out = pa.RecordBatch.from_arrays([part.column("rid"), lists], schema=schema)
                yield out.filter(pa.array(same))
    return run


def _similar_signatures(min_same: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint32)
                    .reshape(b.num_rows, -1) for x in ("sig_a", "sig_b"))
            keep = (a == c).sum(1) >= min_same
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(
                pa.array(keep))
    return run


def _verify(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that hold 100 * |A and B| >= percent * |A or B|."""
    s = sketch.select("rid", "n_shingles", "sig")
    p = pairs
    for c in "ab":
        p = p.join(s.select(F.col("rid").alias(c), F.col("n_shingles").alias(f"n_{c}"),
                            F.col("sig").alias(f"sig_{c}")), c)
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    p = p.where(least * 100 >= most * percent).select("a", "b", "sig_a", "sig_b")
    min_same = math.ceil((percent / 100 - MARGIN) * N_MINIMA)
    p = p.mapInArrow(_similar_signatures(min_same), "a long, b long")
    for c in "ab":
        p = p.join(sets.select(F.col("rid").alias(c), F.col("shingles").alias(f"s_{c}")), c)
    both = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - both
    return p.where(both * 100 >= union * percent).select("a", "b")


def _star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """One large-star (or small-star) step on undirected edges (u, v)."""
    if small:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = e.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("deg"))
    j = join_skewed(e, low, "u", "deg", total, "v")
    if small:  # smaller neighbours and the node itself move to the minimum
        moved = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    else:  # larger neighbours move
        moved = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (u, v).

    Each round is written; it ends when a round changes no edge.
    """
    def print_of(df):
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return r[0], r[1]
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct(), name)
    seen = print_of(e)
    while seen[0]:
        e = materialise(_star(_star(e, False, 2 * seen[0]), True, seen[0]), name)
        now = print_of(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _common(left: list, right: list) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set."""
    n = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) if len(side) else np.zeros(0, np.int64) for side in (left, right)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out
    place = []
    for f, m in zip(flat, n):
        at = np.minimum(np.searchsorted(both, f), len(both) - 1)
        hit = both[at] == f
        place.append((np.repeat(np.arange(len(m)), m)[hit], at[hit]))
    for c in range(0, len(both), 4096):  # incidence matrices of bounded width
        grid = []
        for (row, at), m in zip(place, n):
            use = (at >= c) & (at < c + 4096)
            g = np.zeros((len(m), min(4096, len(both) - c)), np.float32)
            g[row[use], at[use] - c] = 1
            grid.append(g)
        out += grid[0] @ grid[1].T
    return out


def _block_pairs(percent: int):
    """Outsiders of a cluster against other members, one block of each: the pairs in
    different components that can reach the similarity.

    A member is n shingles, of which ``rest`` are not the leader's. Two members
    share at most the smaller count of leader shingles plus their common rest.
    """
    min_same = math.ceil((percent / 100 - MARGIN) * N_MINIMA)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["out"].to_numpy()
        l, r = np.flatnonzero(side), np.flatnonzero(~side)
        rid, root, n = (pdf[c].to_numpy() for c in ("rid", "root", "n_shingles"))
        rest = [np.asarray(x, np.int64) for x in pdf["rest"]]
        kept = n - np.array([len(x) for x in rest])
        most = np.minimum(kept[l][:, None], kept[r][None, :]) + _common([rest[i] for i in l],
                                                                        [rest[i] for i in r])
        union = n[l][:, None] + n[r][None, :] - most
        x, y = np.nonzero((most * 100 >= union * percent) & (root[l][:, None] != root[r][None, :]))
        x, y = l[x], r[y]
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
        near = np.array([(sig[i] == sig[j]).sum() >= min_same for i, j in zip(x, y)], bool)
        a, b = rid[x[near]], rid[y[near]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


def _cross_candidates(members: DataFrame, comp: DataFrame, sketch: DataFrame, sets: DataFrame,
                      percent: int) -> DataFrame:
    """Candidates between components among the members that share a leader.

    All that share a bucket share its leader. Pairs with the leader itself have
    been verified, so clusters of two and pairs without an outsider need no more.
    """
    m = members.where("rid <> leader").select("leader", "rid").distinct().join(
        comp.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn(
        "root", F.coalesce("root", "rid"))
    lead = comp.select(F.col("node").alias("leader"), F.col("root").alias("lead_root"))
    m = m.join(lead, "leader", "left").withColumn("lead_root", F.coalesce("lead_root", "leader"))
    m = materialise(m.select("leader", "rid", "root",
                             (F.col("root") != F.col("lead_root")).alias("out")), "near-clusters")
    mixed = m.groupBy("leader").agg(
        F.count("*").alias("n"), F.sum(F.col("out").cast("long")).alias("n_out")).where(
        "n_out > 0 and n > 1")
    m = join_skewed(m, mixed, "leader", "n", max(1, m.count()), "rid", "inner")
    m = m.join(sketch.select("rid", "sig", "n_shingles"), "rid").join(sets, "rid").join(
        sets.select(F.col("rid").alias("leader"), F.col("shingles").alias("lead_set")), "leader")
    m = materialise(m.select("leader", "rid", "root", "out", "n", "n_out", "n_shingles", "sig",
                             F.array_except("shingles", "lead_set").alias("rest")), "near-clusters")
    h = F.xxhash64("rid")
    n_left = F.ceil(F.col("n_out") / BLOCK).cast("int")
    n_right = F.ceil(F.col("n") / BLOCK).cast("int")
    cols = ["leader", "rid", "root", "n_shingles", "sig", "rest"]
    left = m.where("out").select(*cols, F.lit(True).alias("out"),
                                 F.pmod(h, n_left).cast("int").alias("i"),
                                 F.explode(F.sequence(F.lit(0), n_right - 1)).alias("j"))
    right = m.select(*cols, F.lit(False).alias("out"),
                     F.explode(F.sequence(F.lit(0), n_left - 1)).alias("i"),
                     F.pmod(h, n_right).cast("int").alias("j"))
    return left.unionByName(right).groupBy("leader", "i", "j").applyInPandas(
        _block_pairs(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, row: str | None = None
                    ) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, kept_row) per row of docs.

    ``row`` names a column that numbers the rows, if there is one; ``rid`` is
    that number or a new one. ``kept_row`` marks one row of each component: the
    one with the smallest id.
    """
    d = with_columns_of(docs, {"doc_id": "long", "text": "string"} | ({row: "long"} if row else {}))
    # texts are fetched again by a hash, as rows of a plan have no lasting number
    d = d.withColumn("row_key", F.xxhash64("doc_id", "text"))
    d = d.withColumnRenamed(row, "rid") if row else d.withColumn("rid", F.monotonically_increasing_id())
    sketch = materialise(d.mapInArrow(
        _sketch(k), "rid long, doc_id long, row_key long, n_shingles long, f1 long, f2 long, "
                    "sig binary, bands array<long>"), "near-sketch")
    total = max(1, sketch.count())

    # classes of equal sets; the first row by (id, rid) stands for its class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    classes = materialise(
        sketch.where("n_shingles > 0").groupBy("f1", "f2")
        .agg(F.count("*").alias("copies"), first.alias("r"))
        .select("f1", "f2", "copies", F.col("r.doc_id").alias("first_doc"), F.col("r.rid").alias("rid")),
        "near-classes")
    reps = sketch.select("rid", "row_key", "f1", "f2", "n_shingles", "sig", "bands").join(
        classes.select("rid"), "rid", "left_semi")

    b = reps.select("rid", F.explode("bands").alias("bucket"))
    shared = b.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    mates = join_skewed(b, shared, "bucket", "n", 32 * total, "rid", "inner")
    by_row = mates.groupBy("rid").agg(F.sum("n").alias("mates"),
                                      F.collect_list(F.struct("bucket", "n")).alias("bs"))
    members = materialise(by_row.select("rid", "mates", F.explode("bs").alias("x"))
                          .select("rid", "mates", "x.bucket", "x.n"), "near-buckets")
    leaders = members.groupBy("bucket").agg(
        F.max(F.struct("mates", (-F.col("rid")).alias("r"))).alias("top"), F.count("*").alias("n"))
    leaders = leaders.select("bucket", "n", (-F.col("top.r")).alias("leader"))
    members = materialise(join_skewed(members.select("bucket", "rid"), leaders, "bucket", "n",
                                      32 * total, "rid", "inner"), "near-members")

    # full sets, only of classes that share a bucket; texts are fetched by row key
    wanted = reps.select("rid", "row_key", "f1", "f2").join(
        members.select("rid").distinct(), "rid", "left_semi")
    sets = materialise(
        d.select("row_key", "text").join(wanted, "row_key")
        .select("rid", "f1", "f2", "text").mapInArrow(_sets(k), "rid long, shingles array<long>")
        .dropDuplicates(["rid"]), "near-sets")

    sketch_reps = reps.select("rid", "n_shingles", "sig")
    stars = members.where("rid <> leader").select(F.least("rid", "leader").alias("a"),
                                                  F.greatest("rid", "leader").alias("b")).distinct()
    links = materialise(_verify(stars, sketch_reps, sets, percent)
                        .select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")
    comp = connected_components(links, "near-cc")
    more = materialise(_verify(_cross_candidates(members, comp, sketch_reps, sets, percent),
                               sketch_reps, sets, percent)
                       .select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")
    if more.limit(1).count():
        comp = connected_components(links.unionByName(more), "near-cc")

    # class level: root, smallest id and the kept row of the whole component
    c = classes.join(comp.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn(
        "root", F.coalesce("root", "rid"))
    c = materialise(c.where((F.col("copies") > 1) | F.col("root").isNotNull()), "near-classes")
    whole = c.groupBy("root").agg(
        F.min(F.struct(F.col("first_doc").isNull().alias("no_id"), "first_doc", "rid")).alias("w"),
        F.count("*").alias("n_classes"))
    whole = whole.where("n_classes > 1").select(
        "root", "n_classes", F.col("w.first_doc").alias("component_id"), F.col("w.rid").alias("kept_rid"))
    c = join_skewed(c, whole, "root", "n_classes", total, "rid")
    c = c.select("f1", "f2", "copies", F.coalesce("component_id", "first_doc").alias("component_id"),
                 F.coalesce("kept_rid", "rid").alias("kept_rid"))
    c = c.select(F.col("f1").alias("key"), F.col("f2").alias("key2"), "copies", "component_id", "kept_rid")
    rows = sketch.select("doc_id", "rid", "n_shingles", F.col("f1").alias("key"), "f2")
    out = join_skewed(rows, c, "key", "copies", total, "rid")
    has = (F.col("n_shingles") > 0) & (F.col("f2") == F.col("key2"))
    return out.select(
        "rid", "doc_id", "n_shingles",
        F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(has, F.col("rid") == F.col("kept_rid")).otherwise(F.lit(True)).alias("kept_row"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns as they were."""
    d = numbered(docs, "near-docs")
    kept = near_duplicates(d, k, percent, ROW).where("kept_row").select(F.col("rid").alias(ROW))
    return d.join(kept, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    """Contract of op9_minhash: two-word shingles at similarity 0.8."""
    r = near_duplicates(docs, k=2, percent=80)
    return r.select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
