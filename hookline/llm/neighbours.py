"""Approximate nearest neighbours by cross-polytope hashing (operator 7).

Vectors are brought to the unit sphere, rotated by three rounds of random signs
and a fast Hadamard transform, and hashed to the nearest signed axis, once for
each of TABLES tables. A query visits in each table the PROBES axes nearest to
it; in every bucket visited the exact distances on the original vectors are
computed where the bucket lies and only its TOP nearest leave it, so what moves
grows with the queries, not with queries times bucket sizes. Buckets are split
into blocks of about BLOCK vectors, and the queries that visit one into parts of as many,
so a group holds a bounded number of both.

Vectors of equal length only lose their length. Others get one more coordinate
that lifts them to a sphere around the longest, so that Euclidean nearness is
nearly kept. Equal vectors are one entry with the TOP + 1 smallest ids, which
is all that ties to smaller ids can ask for; a vector that a third of all rows
share is one entry.

A query that finds fewer than TOP neighbours (small tables) visits all buckets
of the first table, which is an exact search.

Vectors that are null, zero, or hold null or non-finite components take no
part, and neither do null ids. Vectors of different dimensions are no neighbours
of each other; each dimension that queries have is searched on its own. Of
repeated ids each different vector takes part; a query's own id is no candidate
for it. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, with_columns_of

TABLES, PROBES, TOP, BLOCK = 16, 8, 10, 4096
#: Bucket numbers are table * WIDTH + axis.
WIDTH = 1 << 32
SEED = 1701


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(x: np.ndarray, longest: float, lift: bool):
    """For each table the rotated unit vectors."""
    v = x / longest
    if lift:
        v = np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], 1)
    size = 1 << (v.shape[1] - 1).bit_length()
    v = np.concatenate([v, np.zeros((len(v), size - v.shape[1]))], 1)
    rng = np.random.default_rng(SEED)
    for _ in range(TABLES):
        y = v
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], size))
        yield y


def axes(y: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) nearest signed axes, nearest first; axis j and its negative j + size."""
    both = np.concatenate([y, -y], 1)
    if n == 1:
        return both.argmax(1)[:, None]
    if n >= both.shape[1]:
        return np.broadcast_to(np.arange(both.shape[1]), both.shape)
    near = np.argpartition(-both, n, 1)[:, :n]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), 1), 1)


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)


def _hash(longest: float, lift: bool, blocks: dict[tuple[int, int], int] | None, probes: int, tables: int):
    """(id, ids, v) -> a row for each table and visited bucket; data rows (probes 1) go to one
    block of the bucket, queries to all."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if not part.num_rows:
                    continue
                x = _matrix(part.column("v"))
                rows, keys, where = [], [], []
                for t, y in zip(range(tables), rotations(x, longest, lift)):
                    near = axes(y, probes)
                    for j in range(near.shape[1]):
                        b = near[:, j]
                        if blocks is None:
                            rows.append(np.arange(len(x))), keys.append(t * WIDTH + b)
                            where.append(np.zeros(len(x), np.int64))
                        else:
                            n = np.array([blocks.get((t, int(a)), 0) for a in b])
                            i = np.repeat(np.arange(len(x)), n)
                            rows.append(i), keys.append((t * WIDTH + b)[i])
                            where.append(np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(where)),
                     *[part.column(c).take(rows) for c in ("id", "ids", "v")]], ["bucket", "block", "id", "ids", "v"])
    return run


def _nearest(top: int):
    """One block of a bucket: the top nearest data ids of each query in it."""
    def run(g: pa.Table) -> pa.Table:
        is_query = g.column("query").to_numpy(zero_copy_only=False)
        q, c = g.filter(pa.array(is_query)), g.filter(pa.array(~is_query))
        out = [[], [], []]
        if len(q) and len(c):
            x, y = _matrix(c.column("v")), _matrix(q.column("v"))
            ids, least = c.column("ids").to_pylist(), c.column("id").to_numpy()
            for query, v in zip(q.column("id").to_pylist(), y):
                d = np.sqrt(((x - v) ** 2).sum(1))
                k = min(top + 1, len(d))
                edge = np.partition(d, k - 1)[k - 1]
                near = np.flatnonzero(d <= edge)
                near = near[np.lexsort((least[near], d[near]))][:top + 1]
                found = sorted({(d[i], j) for i in near for j in ids[i] if j != query})[:top]
                out[0] += [query] * len(found)
                out[1] += [j for _, j in found]
                out[2] += [s for s, _ in found]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})
    return run


_ROWS = "bucket long, block long, id long, ids array<long>, v array<double>"


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``queries`` against those of ``vectors``,
    both (id, v array<double>)."""
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (
        F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    vectors, queries = vectors.where(ok), queries.where(ok)
    empty = "query_id long, rank int, vec_id long, score double"
    sizes = [r["n"] for r in queries.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    found = [_search_size(vectors.where(F.size("v") == n), queries.where(F.size("v") == n), top, probes)
             for n in sizes if vectors.where(F.size("v") == n).limit(1).count()]
    if not found:
        return vectors.sparkSession.createDataFrame([], empty)
    if len(found) == 1:
        return found[0]
    both = materialise(reduce(DataFrame.unionByName, found), "ann-sizes")  # an id may have vectors of several sizes
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return both.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_size(vectors: DataFrame, queries: DataFrame, top: int, probes: int) -> DataFrame:
    """``search`` among vectors of one size."""
    # Equal vectors are one entry. Ids meet in 64 parts first, so a vector that very many rows
    # share is no large group; of each part and then of all the smallest top + 1 ids are kept.
    e = vectors.select("id", "v").distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["v", "part"], ["v"]):
        o = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        e = e.withColumn("o", o).where(F.col("o") <= top + 1)
    entries = materialise(e.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("id"), "ids", "v"), "ann-entries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    lengths = entries.agg(F.min(norm).alias("a"), F.max(norm).alias("b")).first()
    longest, lift = lengths["b"], lengths["b"] > lengths["a"] * 1.001
    index = materialise(entries.mapInArrow(_hash(longest, lift, None, 1, TABLES), _ROWS), "ann-index")
    # at most TABLES * 2 * dimensions buckets
    counts = {r["bucket"]: r["count"] for r in index.groupBy("bucket").count().collect()}
    sizes = {(b // WIDTH, b % WIDTH): -(-n // BLOCK) for b, n in counts.items()}
    q = queries.select("id", "v").distinct().withColumn("ids", F.array("id")).select("id", "ids", "v")
    q = materialise(q, "ann-queries")

    def visit(q, probes, tables):
        rows = q.mapInArrow(_hash(longest, lift, sizes, probes, tables), _ROWS).withColumn("query", F.lit(True))
        visits = rows.where("block = 0").groupBy("bucket").agg(F.count("*").alias("queries"))
        # one row a bucket: blocks of its vectors and parts of its queries
        split = q.sparkSession.createDataFrame(list(counts.items()), "bucket long, vectors long").join(visits, "bucket").select(
            "bucket", F.ceil(F.col("vectors") / BLOCK).alias("blocks"), F.ceil(F.col("queries") / BLOCK).alias("parts"))
        split = F.broadcast(materialise(split, "ann-split"))
        rows = rows.join(split, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        data = index.join(split, "bucket").withColumn("query", F.lit(False)).withColumn(
            "block", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("long")).withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        found = data.unionByName(rows).groupBy("bucket", "block", "part").applyInArrow(
            _nearest(top), "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found = materialise(visit(q, probes, TABLES), "ann-found")
    full = found.where(F.col("rank") == top).select(F.col("query_id").alias("id"))
    short = materialise(q.join(full, "id", "left_anti"), "ann-short")
    if short.limit(1).count():
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(
            visit(short, 1 << 30, 1))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7(embeddings: DataFrame) -> DataFrame:
    """Contract of op7_neighbours: ids divisible by 100 against all rows."""
    v = with_columns_of(embeddings, {"vec_id": "long", "embedding": "array<double>"}).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(v, v.where(F.col("id") % 100 == 0))
