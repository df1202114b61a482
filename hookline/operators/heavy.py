"""The k most frequent terms without counting the whole tail.

Most word pairs of a corpus occur once; a full count shuffles them all to keep a
few thousand. Here each task keeps a bounded summary of what it has read: when
more than ``capacity`` terms are held, the count of the (capacity + 1)-th is taken off
all and those at zero go, so a count is too low by at most what was taken off in
that task. Summaries add up, and so do their errors: a term's true count lies
between its summed count and that plus the total error. Terms whose upper bound reaches
the k-th largest lower bound are candidates and are counted exactly in a second pass;
no other term can enter the top k, not even by a tie. If the error is too large
for that (more candidates than ``MAX_CANDIDATES``), all terms are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path

#: Terms a task's summary holds, per term asked for.
HELD_PER_TERM = 8
#: Candidates that are counted exactly go to every task.
MAX_CANDIDATES = 1_000_000
#: Tokens of a document that reach a Python worker in one row; a batch of rows is bounded by it.
PIECE_TOKENS = 256
#: Tokens that a task handles at a time.
SLICE_TOKENS = 1 << 20


def token_pieces(batch: pa.RecordBatch, col: str, slice_tokens: int = 0) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(first row, end row, their tokens, the row of each) of bounded slices of a token array column."""
    lists = batch.column(col)
    off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(off, off[at] + (slice_tokens or SLICE_TOKENS), "right")) - 1, at + 1)
        yield at, to, lists.slice(at, to - at).flatten().cast(pa.string()), np.repeat(np.arange(at, to), np.diff(off[at:to + 1]))
        at = to


def with_pairs(flat: pa.Array, row: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens and, behind them, every two adjacent ones of a row joined by a space."""
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs = pc.binary_join_element_wise(flat.take(pa.array(inside)), flat.take(pa.array(inside + 1)), " ")
    return pa.concat_arrays([flat, pairs]), np.concatenate([row, row[inside]])


def _pieces(rows: DataFrame, col: str) -> DataFrame:
    """``(doc, n, tokens)``: every token array cut after each ``PIECE_TOKENS`` tokens, a document's pieces
    one after the other. A piece has the next one's first token behind its own ``n``, for the pair across the cut."""
    docs = rows.select(F.monotonically_increasing_id().alias("doc"), F.col(col).alias("_t")).where(F.size("_t") > 0)
    cut = docs.select("doc", "_t", F.explode(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(PIECE_TOKENS))).alias("_at"))
    own = F.least(F.size("_t") - F.col("_at"), F.lit(PIECE_TOKENS))
    return cut.select("doc", own.alias("n"), F.slice("_t", F.col("_at") + 1, F.lit(PIECE_TOKENS + 1)).alias("tokens"))


def piece_terms(batch: pa.RecordBatch, pairs: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(terms, the document of each) of bounded slices of ``_pieces``: own tokens and, if asked, the pairs they begin."""
    doc, n = batch.column("doc").to_numpy(), batch.column("n").to_numpy()
    for at, to, flat, row in token_pieces(batch, "tokens"):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        own = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < n[row]
        terms, of = flat.filter(pa.array(own)), row[own]
        if pairs:
            both, rows = with_pairs(flat, row)
            terms, of = pa.concat_arrays([terms, both.slice(len(flat))]), np.concatenate([of, rows[len(flat):]])
        yield terms, doc[of]


def _summaries(pairs: bool, capacity: int):
    """Pieces -> (term, n) held at the task's end, and (null, error)."""
    def run(batches):
        terms, counts, error = pa.array([], pa.string()), np.zeros(0, np.int64), 0
        for batch in batches:
            for flat, _ in piece_terms(batch, pairs):
                new = pc.value_counts(flat)
                t = pa.table({"t": pa.concat_arrays([terms, new.field("values")]),
                              "n": pa.concat_arrays([pa.array(counts), new.field("counts")])}).group_by("t").aggregate([("n", "sum")])
                terms, counts = t["t"].combine_chunks(), t["n_sum"].to_numpy()
                if len(counts) > capacity:
                    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
                    keep = np.flatnonzero(counts > off)
                    terms, counts, error = terms.take(pa.array(keep)), counts[keep] - off, error + off
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([terms, pa.array([None], pa.string())]),
                                          pa.array(np.append(counts, error))], ["term", "n"])
    return run


def _exact(pairs: bool, wanted: pa.Array):
    """Pieces -> (place among the wanted, occurrences, documents), summed over the task."""
    def run(batches):
        n, df = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        open_, seen = -1, np.zeros(0, np.int64)   # the last document read, which may go on, and its terms so far
        for batch in batches:
            for flat, doc in piece_terms(batch, pairs):
                ids = pc.index_in(flat, value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                docs, row = np.unique(doc, return_inverse=True)
                row, ids = row[ids >= 0], ids[ids >= 0]
                n += np.bincount(ids, minlength=len(wanted))
                once = np.unique(row * np.int64(len(wanted)) + ids)
                row, ids = once // max(len(wanted), 1), once % max(len(wanted), 1)
                df += np.bincount(ids, minlength=len(wanted))
                if docs[0] == open_:   # terms that its earlier pieces had are counted already
                    df[np.intersect1d(ids[row == 0], seen)] -= 1
                last = ids[row == len(docs) - 1]
                seen = np.union1d(seen, last) if docs[-1] == open_ else last
                open_ = docs[-1]
        use = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(use), pa.array(n[use]), pa.array(df[use])], ["place", "n", "df"])
    return run


def full_count(rows: DataFrame, col: str, pairs: bool = False) -> DataFrame:
    """``(term, n, df)`` of every term."""
    def run(batches):
        for batch in batches:
            for at, _, flat, row in token_pieces(batch, col):
                if pairs:
                    flat, row = with_pairs(flat, row)
                code = pc.dictionary_encode(flat)
                ids, size = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(code.dictionary), 1)
                yield pa.RecordBatch.from_arrays(
                    [code.dictionary, pa.array(np.bincount(ids, minlength=len(code.dictionary))),
                     pa.array(np.bincount(np.unique((row - at) * size + ids) % size, minlength=len(code.dictionary)))],
                    ["term", "n", "df"])
    return rows.select(col).mapInArrow(run, "term string, n long, df long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"))


def top_counts(rows: DataFrame, col: str, k: int, pairs: bool = False, capacity: int | None = None) -> DataFrame:
    """``(term, n, df)`` of the ``k`` most frequent terms (ties by term) of an array column, exact.

    ``pairs`` counts adjacent pairs too. Two passes over ``rows``; what moves is bounded by
    ``capacity`` rows a task.
    """
    spark = rows.sparkSession
    capacity = capacity or HELD_PER_TERM * k
    summed = _pieces(rows, col).mapInArrow(_summaries(pairs, capacity), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("term")]
    path = scratch_path(spark, "heavy")
    try:
        summed.write.parquet(path)   # written once, so that counts and error belong together
        kept = spark.read.schema(summed.schema).parquet(path)
        error = kept.where("term IS NULL").first()
        error = int(error["n"]) if error else 0
        known = kept.where("term IS NOT NULL")
        top = known.orderBy(*order).limit(k).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c")).first()
        least = int(top["n"]) - error if top["c"] == k else 1 - error
        # with fewer than k terms held, a term that no summary holds may belong to the top too
        wanted = None if top["c"] < k and error else \
            [r["term"] for r in known.where(F.col("n") >= least).select("term").limit(MAX_CANDIDATES + 1).collect()]
    finally:
        drop_path(spark, path)
    if wanted is None or len(wanted) > MAX_CANDIDATES:
        return full_count(rows, col, pairs).orderBy(*order).limit(k)
    wanted = sorted(wanted)
    counted = _pieces(rows, col).mapInArrow(_exact(pairs, pa.array(wanted, pa.string())), "place long, n long, df long") \
                  .groupBy("place").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    names = spark.createDataFrame(list(enumerate(wanted)), "place long, term string")   # bounded by MAX_CANDIDATES
    return counted.join(F.broadcast(names), "place").select("term", "n", "df").orderBy(*order).limit(k)
