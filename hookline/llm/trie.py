"""Conversation prefix trie (operator 13) in balanced parentheses.

Conversations are rebuilt (their first turns replaced by those of their group's
head), and every distinct sequence of first turns is a node. A node's key is the
exclusive or of 64-bit hashes of (turn digest, place) over its turns, in two
independent lanes of 64 bits: equal sequences have equal keys whatever the conversation, and a
running key is a running sum, which splits anywhere.

1. ``rebuilt``: turns as 16-byte digests and word counts; texts go no further. Rows are sorted
   by conversation and turn into range shards, so that one endless conversation
   spreads over many; places and keys run within a shard, and the at most one
   conversation that a shard continues takes its start from a table with a row a shard.
2. Nodes with one member lie on that conversation's own tail. A tail is one leaf, hung
   below its last shared node; only shared nodes reach the trie.
3. Distinct shared paths, sorted, are cut into shards. A shard writes its
   nodes in preorder as balanced parentheses. A tree of block minima over
   the excess (range min-max) answers findclose, which delimits each subtree; ranks of the
   leaf pairs "()" and cumulative arrays over preorder give its leaves, members and savings.
4. Only nodes on a shard's first or last path, its spine, can lie in several shards. They leave
   the shard with the sums of what hangs below them off the spine, are merged
   by path, and the merged spines (two paths a shard) are encoded the same way.

Rows: a null conv_id names no conversation, such rows take no part. A null role or
text is empty; a null turn comes first; turns with equal numbers follow their digests, and repeated
rows are turns of their own. ``%`` keeps the sign of a negative conv_id. A conversation without
turns after rebuilding is a member of the root alone. An empty table has no nodes. Other
columns are ignored. A path of shared turns is one cell (40 bytes a turn).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, materialise, with_columns_of

GROUP = 20
MAX_HEAD = 3  # the number of head turns is a hash modulo 4
#: A node with more members is joined by broadcast; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 1_000_000
#: Longer tails are expanded piece by piece.
PIECE = 4096
WORD = r"[^\x20\x09-\x0D]+"


# --- rebuilding ---------------------------------------------------------------

def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words)."""
    t = with_columns_of(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return t.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def in_shards(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows dealt by ranges of the order, written with the number of their range."""
    return materialise(df.repartitionByRange(*order).withColumn("shard", F.spark_partition_id()), name)


def carried(totals: DataFrame, **values: Column) -> DataFrame:
    """What a conversation has gathered before each shard that continues it: at most one
    row a shard, as a shard is a range and so continues one conversation at most."""
    before = Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("conv_id", "shard", *[v.over(before).alias(k) for k, v in values.items()]).dropna()


def placed(df: DataFrame, order: list) -> DataFrame:
    """Adds ``place`` (from 1) of each row in its conversation."""
    here = Window.partitionBy("conv_id", "shard").orderBy(*order)
    totals = df.groupBy("conv_id", "shard").agg(F.count("*").alias("rows"))
    before = carried(totals, before=F.sum("rows"))
    return df.withColumn("_n", F.row_number().over(here)).join(F.broadcast(before), ["conv_id", "shard"], "left") \
        .withColumn("place", F.col("_n") + F.coalesce("before", F.lit(0))).drop("_n", "before")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, k1, k2, words) a rebuilt turn, (conv_id) a conversation)."""
    # equal rows of one conversation must split too, so the order ends in a row number
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_row")]
    raw = in_shards(turns(conversations).withColumn("_row", F.xxhash64(F.monotonically_increasing_id())),
                    [F.col("conv_id"), *order], "trie-turns")
    own = placed(raw, order).select("conv_id", "place", "digest", "words")
    convs = raw.groupBy("conv_id").agg(F.lit(1).alias("one")).drop("one")
    first = own.where((F.col("place") <= MAX_HEAD) & (F.col("conv_id") % GROUP == 0)).groupBy(
        F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    h = head_turns(F.col("conv_id")).cast("int")
    heads = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).where(h > 0).join(first, "base").select(
        "conv_id", F.explode(F.slice("head", 1, h)).alias("t")).select("conv_id", F.lit(0).alias("part"), "t.*")
    tails = own.where(F.col("place") > h).withColumn("part", F.lit(1))
    order = ["part", "at"]
    path = in_shards(heads.unionByName(tails).withColumnRenamed("place", "at"), ["conv_id", *order], "trie-path")
    path = placed(path, order).withColumn("a", F.xxhash64("digest", "place")).withColumn(
        "b", F.xxhash64("place", F.lit("b"), "digest"))
    path = materialise(path, "trie-placed")
    totals = path.groupBy("conv_id", "shard").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    before = carried(totals, ca=F.bit_xor("ta"), cb=F.bit_xor("tb"))
    here = Window.partitionBy("conv_id", "shard").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    keyed = path.withColumn("xa", F.bit_xor("a").over(here)).withColumn("xb", F.bit_xor("b").over(here)).join(
        F.broadcast(before), ["conv_id", "shard"], "left")
    nodes = keyed.select("conv_id", F.col("place").alias("depth"),
                         F.col("xa").bitwiseXOR(F.coalesce("ca", F.lit(0))).alias("k1"),
                         F.col("xb").bitwiseXOR(F.coalesce("cb", F.lit(0))).alias("k2"), "words")
    return materialise(nodes, "trie-keys"), convs


# --- shared paths ---------------------------------------------------------------

def shared_paths(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, turns, path) a conversation: the number of its rebuilt turns and the shared nodes
    (depth, k1, k2, words, conv_id of the smallest member) on its way."""
    members = nodes.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("conv_id").alias("m")).where("n > 1")
    shared = materialise(members, "trie-shared")
    total = nodes.count()
    is_hot = (F.col("n") * HOT_SHARE > total) | (F.col("n") > HOT_ROWS)
    hot = F.broadcast(shared.where(is_hot).drop("n"))  # fewer than HOT_SHARE + total / HOT_ROWS rows
    key = ["k1", "k2"]
    on = nodes.join(hot, key).unionByName(
        nodes.join(hot, key, "left_anti").join(shared.where(~is_hot).drop("n"), key))
    paths = on.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "words", "m"))).alias("path"))
    turns_of = nodes.groupBy("conv_id").agg(F.max("depth").alias("turns"))
    none = F.expr("CAST(array() AS array<struct<depth:bigint,k1:bigint,k2:bigint,words:bigint,m:bigint>>)")
    out = convs.join(turns_of, "conv_id", "left").join(paths, "conv_id", "left").select(
        "conv_id", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"), F.coalesce("path", none).alias("path"))
    return materialise(out, "trie-paths")


# --- balanced parentheses ---------------------------------------------------------

class Parentheses:
    """A tree in preorder as balanced parentheses with a range min-max tree on the excess.

    ``depth`` are the depths of the nodes in preorder, the root's first and alone at 0.
    """

    BLOCK = 64

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.open = 2 * np.arange(n) - depth  # as many closed before a node as are neither before it nor above
        step = np.full(2 * n, -1, np.int8)
        step[self.open] = 1
        self.excess = np.cumsum(step, dtype=np.int64)
        self.pairs = np.flatnonzero((step[:-1] == 1) & (step[1:] == -1))  # "()": leaves
        least = np.full(-(-2 * n // self.BLOCK) * self.BLOCK, np.iinfo(np.int64).max)
        least[:2 * n] = self.excess
        self.mins = [least.reshape(-1, self.BLOCK).min(1)]
        while len(self.mins[-1]) > 1:
            m = self.mins[-1]
            m = np.append(m, np.iinfo(np.int64).max) if len(m) % 2 else m
            self.mins[-1] = m
            self.mins.append(m.reshape(-1, 2).min(1))

    def _scan(self, todo: np.ndarray, start: np.ndarray, target: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Look for excess <= target from ``start`` to the end of its block; who is left."""
        stop = np.minimum((start // self.BLOCK + 1) * self.BLOCK, len(self.excess))
        for k in range(self.BLOCK):
            if not len(todo):
                break
            at = start[todo] + k
            inside = at < stop[todo]
            hit = inside & (self.excess[np.minimum(at, len(self.excess) - 1)] <= target[todo])
            found[todo[hit]] = at[hit]
            todo = todo[~hit & inside]
        return np.flatnonzero(found < 0)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place where the excess falls
        below what it was before. Own block, then up and down the tree of minima, then one block."""
        target = self.excess[at] - 1
        found = np.full(len(at), -1, np.int64)
        same = np.flatnonzero((at + 1) // self.BLOCK == at // self.BLOCK)
        far = self._scan(same, at + 1, target, found)
        node, level = at // self.BLOCK, np.full(len(at), -1)
        todo = far
        for up, mins in enumerate(self.mins):
            if not len(todo):
                break
            i = node[todo]
            right = np.minimum(i + 1, len(mins) - 1)
            hit = (i % 2 == 0) & (right > i) & (mins[right] <= target[todo])
            node[todo[hit]] += 1
            level[todo[hit]] = up
            todo = todo[~hit]
            node[todo] >>= 1
        for down in range(len(self.mins) - 1, 0, -1):
            use = far[level[far] >= down]
            left = 2 * node[use]
            node[use] = left + (self.mins[down - 1][left] > target[use])
        self._scan(far, node * self.BLOCK, target, found)
        return found

    def leaf_rank(self, at: np.ndarray) -> np.ndarray:
        """Leaf pairs that open before a place."""
        return np.searchsorted(self.pairs, at)


class Subtrees:
    """Sums over subtrees, a subtree's own top included."""

    def __init__(self, depth: np.ndarray):
        self.depth = depth
        self.code = Parentheses(depth)
        self.close = self.code.findclose(self.code.open)
        self.end = np.arange(len(depth)) + (self.close - self.code.open + 1) // 2

    def total(self, value: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(value)])
        return c[self.end] - c[:-1]

    def leaves(self, weight: np.ndarray) -> np.ndarray:
        """Weights of the leaves below each node, by rank of their pairs."""
        leaf = np.flatnonzero(self.close == self.code.open + 1)  # in the order of their pairs
        c = np.concatenate([[0], np.cumsum(weight[leaf])])
        return c[self.code.leaf_rank(self.close)] - c[self.code.leaf_rank(self.code.open)]

    def parents(self) -> np.ndarray:
        """The last node before each that is one level up; the root has -1."""
        n = len(self.depth)
        key = self.depth * (n + 1) + np.arange(n)
        order = np.argsort(key)
        above = np.searchsorted(key[order], key - (n + 1)) - 1
        return np.where(self.depth > 0, order[above], -1)


# --- shards and spines -------------------------------------------------------------

_PATH = pa.list_(pa.struct([(c, pa.int64()) for c in ("depth", "k1", "k2", "words", "m")]))
_NODE = ("depth", "k1", "k2", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved", "words")
_SHARD = pa.schema([(c, pa.int64()) for c in _NODE] + [("path", _PATH)])
_SHARD_DDL = ", ".join(f"{c} long" for c in _NODE) + (
    ", path array<struct<depth:bigint,k1:bigint,k2:bigint,words:bigint,m:bigint>>")


def _whole(batches) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks() if batches else None


def _lists(col: pa.ChunkedArray) -> tuple[np.ndarray, dict[str, np.ndarray], pa.ListArray]:
    col = col.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    sizes = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = col.flatten()
    return (np.concatenate([[0], np.cumsum(sizes)]),
            {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}, col)


def _shard(batches):
    """Sorted distinct paths of a shard -> its nodes; those on its spine with their path and
    what hangs below them off the spine."""
    t = _whole(batches)
    if t is None:
        return
    off, f, paths = _lists(t.column("path"))
    ends, low, tails = (t.column(c).to_numpy() for c in ("n", "m", "tails"))
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(off[-1]) - off[row]
    # a node is new in a row unless the row before goes through it; keys cover the way from the root
    prev = np.where(row > 0, off[np.maximum(row - 1, 0)] + at, -1)
    known = (row > 0) & (at < size[np.maximum(row - 1, 0)])
    known[known] = (f["k1"][prev[known]] == f["k1"][known]) & (f["k2"][prev[known]] == f["k2"][known])
    new = np.flatnonzero(~known)
    # preorder: the root, and row by row its new nodes and the bundle of tails below the last of them
    bundles = np.flatnonzero(tails > 0)
    kind = np.concatenate([[0], np.zeros(len(new), int), np.ones(len(bundles), int)])
    of = np.concatenate([[-1], row[new], bundles])
    order = np.argsort(2 * of + kind, kind="stable")
    depth = np.concatenate([[0], at[new] + 1, size[bundles] + 1])[order]
    kind, of = kind[order], of[order]

    def per_node(values, root):
        return np.concatenate([[root], values[new], np.zeros(len(bundles), np.int64)])[order]
    k1, k2, words = per_node(f["k1"], 0), per_node(f["k2"], 0), per_node(f["words"], 0)
    m = per_node(f["m"], low.min())
    node = np.flatnonzero(kind == 0)
    last = np.zeros(len(size), np.int64)  # each row's last node: the last that is not a bundle up to the row
    last[:] = node[np.searchsorted(of[node], np.arange(len(size)), "right") - 1]
    tree = Subtrees(depth)
    up = tree.parents()
    mine = np.zeros(len(depth), np.int64)
    np.add.at(mine, last, ends)
    members = tree.total(mine)
    weight = np.ones(len(depth), np.int64)
    weight[kind == 1] = tails[of[kind == 1]]
    own = np.where(kind == 0, (members - 1) * words, 0)
    leaves, saved = tree.leaves(weight), tree.total(own)
    kids = np.bincount(up[1:], weight[1:] * (kind[1:] == 1) + (kind[1:] == 0), len(depth)).astype(np.int64)
    spine = np.zeros(len(depth), bool)
    spine[(of <= 0) & (kind == 0)] = True
    i = last[-1]
    while i >= 0:
        spine[i] = True
        i = up[i]
    s = np.flatnonzero(spine)
    below = s[1:]  # spine nodes but the root; what they hold is counted with them
    off_leaves, off_saved, off_kids = leaves.copy(), saved - own, kids.copy()
    off_leaves[(kids == 0)] = 0
    np.subtract.at(off_leaves, up[below], leaves[below])
    np.subtract.at(off_saved, up[below], saved[below])
    np.subtract.at(off_kids, up[below], 1)
    use = np.flatnonzero((kind == 0) & ~spine)
    parent = np.where(up >= 0, m[up], 0)
    yield from pa.table([depth[use], k1[use], k2[use], m[use], parent[use], members[use], kids[use], leaves[use],
                         saved[use], words[use], pa.nulls(len(use), _PATH)], schema=_SHARD).to_batches(10_000)
    # a spine node's path is a prefix of its row's
    rows = np.maximum(of[s], 0)
    got = [paths[int(r)].as_py()[:int(d)] for r, d in zip(rows, depth[s])]
    yield from pa.table([depth[s], k1[s], k2[s], m[s], parent[s], members[s], off_kids[s], off_leaves[s], off_saved[s],
                         words[s], pa.array(got, _PATH)], schema=_SHARD).to_batches(10_000)


def _spines(batches):
    """Merged spine nodes in preorder -> nodes."""
    t = _whole(batches)
    if t is None:
        return
    c = {n: t.column(n).to_numpy() for n in _NODE}
    tree = Subtrees(c["depth"])
    up = tree.parents()
    kids = c["n_children"] + np.bincount(up[1:], minlength=len(up)).astype(np.int64)
    leaves = tree.total(np.where(kids == 0, 1, c["n_leaves"]))
    saved = tree.total(c["saved"] + (c["n_convs"] - 1) * c["words"])
    parent = np.where(up >= 0, c["conv_id"][up], 0)
    yield from pa.table([c["depth"], c["k1"], c["k2"], c["conv_id"], parent, c["n_convs"], kids, leaves, saved,
                         c["words"], pa.nulls(len(up), _PATH)], schema=_SHARD).to_batches(10_000)


def shared_nodes(paths: DataFrame) -> DataFrame:
    """All shared nodes and the root, by the shards' encodings and their merged spines."""
    distinct = paths.groupBy("path").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("m"),
        F.count(F.when(F.col("turns") > F.size("path"), 1)).alias("tails"))
    parts = materialise(distinct.repartitionByRange("path").sortWithinPartitions("path")
                        .mapInArrow(_shard, _SHARD_DDL), "trie-shards")
    sums = ("n_convs", "n_children", "n_leaves", "saved")
    spines = parts.where("path IS NOT NULL").groupBy("path").agg(
        *[(F.sum if c in sums else F.min)(c).alias(c) for c in _NODE])
    # two paths a shard: few, whatever the rows, so one task reads them in preorder
    merged = spines.repartition(1).sortWithinPartitions("path").select(*_NODE).mapInArrow(_spines, _SHARD_DDL)
    return parts.where("path IS NULL").unionByName(merged).drop("path", "words")


# --- digests of ends ------------------------------------------------------------------

def _digests(batches):
    """Sorted (depth, k1, k2, first, ids) -> one running digest a node."""
    key, sha = None, None
    for batch in batches:
        out = []
        for d, a, b, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")]):
            if (d, a, b) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (d, a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "k1", "k2", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], ["depth", "k1", "k2", "sha"])


def ends(paths: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha) of shared nodes at which conversations end. Ids are joined to strings
    by ranges of ids, so that a node where very many end is a few long rows to digest in order."""
    top = F.when(F.size("path") > 0, F.element_at("path", F.greatest(F.size("path"), F.lit(1))))
    at = paths.where(F.col("turns") == F.size("path")).select(
        F.size("path").cast("long").alias("depth"), F.coalesce(top["k1"], F.lit(0)).alias("k1"),
        F.coalesce(top["k2"], F.lit(0)).alias("k2"), "conv_id")
    key = ["depth", "k1", "k2"]
    pieces = at.repartitionByRange("conv_id").withColumn("shard", F.spark_partition_id()).groupBy(*key, "shard").agg(
        F.sort_array(F.collect_list("conv_id")).alias("c")).select(
        *key, F.col("c")[0].alias("first"), F.array_join(F.col("c").cast("array<string>"), ",").alias("ids"))
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(
        _digests, "depth long, k1 long, k2 long, sha string")


# --- the whole trie -------------------------------------------------------------------

def tail_nodes(paths: DataFrame, root: int) -> DataFrame:
    """Nodes with one member, from each conversation's shared depth to its end."""
    s = F.size("path").cast("long")
    above = F.when(s > 0, F.element_at("path", F.greatest(F.size("path"), F.lit(1)))["m"]).otherwise(F.lit(root))
    own = paths.where(F.col("turns") > s).select("conv_id", "turns", s.alias("s"), above.alias("above"))
    long = F.col("turns") - F.col("s") > PIECE
    pieces = own.where(long).withColumn("a", F.explode(F.expr(f"sequence(s + 1, turns, {PIECE}L)")))         .repartition("conv_id", "a").withColumn("z", F.least(F.col("a") + PIECE - 1, "turns"))
    short = own.where(~long).withColumn("a", F.col("s") + 1).withColumn("z", F.col("turns"))
    d = short.unionByName(pieces).withColumn("depth", F.explode(F.expr("sequence(a, z)")))
    is_end = F.col("depth") == F.col("turns")
    return d.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("s") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent"),
        F.lit(1).cast("long").alias("n_convs"), F.when(is_end, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
        F.sha2(F.when(is_end, F.col("conv_id").cast("string")).otherwise(F.lit("")).cast("binary"), 256).alias("sha"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = shared_paths(*rebuilt(conversations))
    root = paths.agg(F.min("conv_id")).first()[0]
    shared = shared_nodes(paths).join(ends(paths), ["depth", "k1", "k2"], "left").withColumn(
        "sha", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))).withColumn(
        "parent", F.when(F.col("depth") == 1, F.lit(root)).when(F.col("depth") > 1, F.col("parent")))
    both = shared.drop("k1", "k2").unionByName(tail_nodes(paths, root))
    return both.select("conv_id", "depth", F.col("parent").cast("long").alias("parent_conv_id"), "n_convs", "n_children",
                       "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def op13(conversations: DataFrame) -> DataFrame:
    """Contract of op13_trie."""
    return trie(conversations)


#: crc32 of a conversation's decimal id, low two bits, is computed bit by bit: DuckDB has no such function.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 'w': words} ORDER BY pos) AS own FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS base,
         xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT),
           lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
             lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 4 AS h
  FROM own),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq
  FROM c LEFT JOIN own b ON b.conv_id = c.base),
m AS (
  SELECT conv_id, d, len(seq) AS n, list_transform(seq[1:d], lambda x: x.k) AS key,
         CASE WHEN d > 0 THEN seq[d].w ELSE 0 END AS w
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
nodes AS (
  SELECT d, coalesce(array_to_string(key, ','), '') AS key, coalesce(array_to_string(key[1:d - 1], ','), '') AS above,
         min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends,
         any_value(key) AS steps
  FROM m GROUP BY d, 2, 3),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
n2 AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, key)),
sub AS (
  SELECT j AS d, coalesce(array_to_string(steps[1:j], ','), '') AS key,
         sum((n_convs - 1) * w) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT steps, n_convs, w, n_children, unnest(range(0, d + 1)) AS j FROM n2) GROUP BY 1, 2)
SELECT n2.conv_id, n2.d AS depth, p.conv_id AS parent_conv_id, n2.n_convs, n2.n_children,
       CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(n2.ends) AS ends_sha256
FROM n2 JOIN sub USING (d, key) LEFT JOIN nodes p ON n2.d > 0 AND p.d = n2.d - 1 AND p.key = n2.above
"""
