"""Substring dedup by content-defined chunking (operator 5).

A gear hash rolls over the UTF-8 bytes of each whole text, from its first byte;
where its top bits are zero a chunk ends, so an insertion moves no boundary but
those beside it, and equal texts have equal chunks wherever they lie.
Chunks (MIN_CHUNK to MAX_CHUNK bytes, about 48 on average, never within a
character) are counted by a 96-bit digest over all documents; a digest seen in
several documents is repeated. Its first occurrence is in the document with the smallest
(doc_id, hash of the text), wherever its file lies. Consecutive repeated chunks of a document
that are all first occurrences (which stay) or all copies (which go) form a run; runs of at
least MIN_RUN bytes are reported, cut into stretches with the same first occurrence. So a
short copy between first occurrences stays, whatever is copied beside it elsewhere.

A repeated passage loses about a chunk at either end, as its first and last
chunk also cover what stands beside it; passages of over 50 words hold several
whole chunks.

Hot digests (a line that a third of all documents share) are joined by
broadcast; there are fewer than HOT_SHARE of them.

Rows: null and empty texts have no chunks and no runs. Repeated rows repeat
each other. A null ``doc_id`` is kept and comes before all others. Extra columns are ignored by the search
and kept by ``drop_repeats``.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, join_skewed, materialise, numbered, slices, utf8, with_columns_of

MIN_CHUNK, MAX_CHUNK, NEAR_CUT, BITS = 16, 160, 64, 5
MIN_RUN = 96

_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """At each byte the sum of G[b] << age over the last 32 bytes of its row, by doubling the window."""
    h = _GEAR[buf]
    w = 1
    while w < 32:
        shifted = h[:-w] << np.uint32(w) if len(h) > w else h[:0]
        h = h.copy()
        heads = off[:-1, None] + np.arange(w)  # a row's first bytes see nothing of the row before
        heads = heads[heads < off[1:, None]]
        own = h[heads]
        h[w:] += shifted
        h[heads] = own
        w *= 2
    return h


def cuts_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all rows, and the row of each."""
    h = gear_hashes(buf, off)
    ends = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    lead = (buf & 0xC0) != 0x80  # a character's first byte
    ends = ends[ends < len(buf)]
    while len(ends):  # out of characters
        bad = np.flatnonzero(~lead[ends])
        if not len(bad):
            break
        ends[bad] += 1
        ends = ends[ends < len(buf)]
    places = ends.tolist()
    out, rows = [], []
    for r in range(len(off) - 1):
        at, stop = int(off[r]), int(off[r + 1])
        while at < stop:
            i = bisect_left(places, at + MIN_CHUNK)
            to = min(places[i] if i < len(places) else stop, stop)
            if to - at > MAX_CHUNK:
                # no end in reach, as in periodic text: the first largest hash is content-defined too
                to = at + MIN_CHUNK + int(h[at + MIN_CHUNK - 1:at + NEAR_CUT - 1].argmax())
                while not lead[to]:
                    to += 1
            out.append(to)
            rows.append(r)
            at = to
    return np.array(out, np.int64), np.array(rows, np.int64)


def _chunks():
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int32()), ("place", pa.int32()), ("span", pa.int64()),
                        ("d1", pa.int64()), ("d2", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = utf8(part.column("text"))
                ends, rows = cuts_of(buf, off)
                if not len(ends):
                    continue
                first = np.searchsorted(rows, rows)  # the row's first chunk
                start = np.where(np.arange(len(ends)) == first, off[rows], np.concatenate([[0], ends[:-1]]))
                raw = buf.tobytes()
                d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in
                                            zip(start.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)
                points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                base = points[off[rows]]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(take), part.column("doc_id").take(take),
                     part.column("text_hash").take(take), pa.array((np.arange(len(ends)) - first).astype(np.int32)),
                     # where it starts, its code points and its bytes in one number: what moves is rows of few longs
                     pa.array(((points[start] - base) << 16) + ((points[ends] - points[start]) << 8) + (ends - start)),
                     pa.array(d[:, 0]),
                     pa.array(d[:, 1].astype(np.int32))], schema=schema)
    return run


def repeated_runs(docs: DataFrame, row: str | None = None, min_run: int = MIN_RUN) -> DataFrame:
    """(row, doc_id, start, end, bytes, chunks, first_doc_id, is_first) per run of repeated chunks;
    start and end in code points, end exclusive."""
    d = with_columns_of(docs, {"doc_id": "long", "text": "string"} | ({row: "long"} if row else {}))
    d = d.withColumnRenamed(row, "row") if row else d.withColumn("row", F.monotonically_increasing_id())
    chunks = materialise(d.withColumn("text_hash", F.hash("text")).mapInArrow(
        _chunks(), "row long, doc_id long, text_hash int, place int, span long, d1 long, d2 int"),
        "cdc-chunks")
    # first: the smallest (doc_id, text hash, row); it stays
    first = F.min(F.struct("doc_id", "text_hash", "row"))
    repeated = chunks.groupBy("d1", "d2").agg(
        F.count("*").alias("n"), first.alias("f"), F.min("row").alias("low"), F.max("row").alias("high")).where(
        "low <> high").select(F.col("d1"), F.col("d2").alias("e2"), "n", F.col("f.row").alias("first_row"),
                              F.col("f.doc_id").alias("first_doc_id"))
    hit = join_skewed(chunks.drop("text_hash"), repeated, "d1", "n", max(1, chunks.count()), "row", "inner").where("d2 = e2")
    hit = hit.withColumn("is_first", F.col("row") == F.col("first_row"))
    # a run: consecutive chunks, all first occurrences or all copies
    order = Window.partitionBy("row", "is_first").orderBy("place")
    hit = hit.withColumn("run", F.col("place") - F.row_number().over(order))
    # a stretch: consecutive chunks of a run with the same first occurrence
    before = Window.partitionBy("row", "is_first", "run").orderBy("place")
    turn = (F.lag("first_row").over(before) != F.col("first_row")).cast("int")
    hit = hit.withColumn("turn", F.coalesce(turn, F.lit(0)))
    hit = hit.withColumn("stretch", F.sum("turn").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    start, chars = F.shiftright("span", 16), F.shiftright("span", 8).bitwiseAND(255)
    runs = hit.groupBy("row", "is_first", "run", "stretch").agg(
        F.min("doc_id").alias("doc_id"), F.min(start).alias("start"), F.max(start + chars).alias("end"),
        F.sum(F.col("span").bitwiseAND(255)).alias("bytes"), F.count("*").alias("chunks"), F.first("first_doc_id").alias("first_doc_id"))
    whole = Window.partitionBy("row", "is_first", "run")
    runs = runs.withColumn("whole", F.sum("bytes").over(whole)).where(F.col("whole") >= min_run)
    return runs.select("row", "doc_id", "start", "end", "bytes", "chunks", "first_doc_id", "is_first")


def drop_repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The rows with the copies of repeated runs cut out of their texts, other columns as they were."""
    d = numbered(docs, "cdc-docs")
    cuts = repeated_runs(d, ROW, min_run).where("not is_first").groupBy(F.col("row").alias(ROW)).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    x = d.join(cuts, ROW, "left")
    # between the cuts: from the end of one to the start of the next
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.length("text").cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(
        F.col("text"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    kept = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return x.withColumn("text", kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    """Runs of repeated chunks in all documents."""
    return repeated_runs(docs).select("doc_id", "start", "end", "bytes", "chunks", "first_doc_id", "is_first")
