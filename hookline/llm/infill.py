"""Fill-in-middle transformation (operator 12) over a piecewise-linear learned rank index.

A text is cut into tokens: white space with the run behind it, or the white space
that ends the text. The index of a document maps a boundary's rank 0..n to its
byte offset: segments of straight lines, each as long as a line can stay within
``ERROR`` bytes of every boundary it covers (shrinking cone), and one signed byte
a boundary for what the line misses. A cut is looked up by rank: the segment is
found by binary search, the line predicts, the stored residual corrects exactly.
Regular texts need one or two segments, so an index takes about a byte a token
where offsets would take eight.

Which documents change, their cut ranks and their form follow from the first four
words of sha256("42:" + doc_id): nothing depends on partitions or order.

Plan: one pass without a shuffle; Python sees a slice of rows at a time, digests
and the restoration are column expressions.

Rows: a null text counts as empty and stays plain, as do texts that contain a
sentinel. A null ``doc_id`` hashes as the empty string. Repeated rows give equal
results, once a row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, slices, utf8, with_columns_of

ERROR = 126  # a residual fits a signed byte, with one to spare for rounding
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT = 50
SPM_PERCENT = 80


class RankIndex:
    """Offset of the k-th boundary, k = 0..n, of a non-decreasing sequence of offsets."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        first, base, slope = [], [], []
        at = 0
        while at < len(offsets):
            end, s = _longest_line(offsets, at, error)
            first.append(at)
            base.append(int(offsets[at]))
            slope.append(s)
            at = end
        self.first, self.base = np.array(first, np.int64), np.array(base, np.int64)
        self.slope = np.array(slope, np.float64)
        missed = offsets - self.predict(np.arange(len(offsets)))
        self.residual = missed.astype(np.int8)
        if (self.residual != missed).any():
            raise AssertionError("a boundary lies outside the error bound of its segment")

    def predict(self, rank):
        seg = np.searchsorted(self.first, rank, "right") - 1
        return self.base[seg] + np.floor(self.slope[seg] * (rank - self.first[seg])).astype(np.int64)

    def __getitem__(self, rank: int) -> int:
        return int(self.predict(rank) + self.residual[rank])


def _longest_line(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """(first boundary not covered, slope) of the longest line that starts exactly at
    boundary ``at``; the cone of admissible slopes shrinks block by block."""
    lo, hi, end, block = -np.inf, np.inf, at + 1, 256
    while end < len(offsets):
        step = np.arange(end, min(end + block, len(offsets))) - at
        rise = (offsets[end:end + block] - offsets[at]).astype(np.float64)
        low = np.maximum(np.maximum.accumulate((rise - error) / step), lo)
        high = np.minimum(np.minimum.accumulate((rise + error) / step), hi)
        out = np.flatnonzero(low > high)
        n = int(out[0]) if len(out) else len(step)
        if n:
            lo, hi, end = low[n - 1], high[n - 1], end + n
        if len(out):
            break
        block *= 2
    return end, 0.0 if end == at + 1 else float((lo + hi) / 2)


def boundaries(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all tokens of all rows, and where each row's ends begin (n + 1 places)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = SPACE[buf]
    last = np.zeros(len(buf), bool)
    last[off[1:][off[1:] > off[:-1]] - 1] = True
    stop = ~gap
    stop[:-1] &= gap[1:] | last[:-1]
    stop |= last
    end = np.flatnonzero(stop) + 1
    return end, np.searchsorted(end, off, "right")


def draws(doc_id: int | None) -> tuple[int, ...]:
    """h1 to h4 of a document."""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * i:8 * i + 8], 16) for i in range(4))


def _code_points(b: np.ndarray) -> int:
    return int(np.count_nonzero((b & 0xC0) != 0x80))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                     ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                     ("output", pa.binary()), ("segments", pa.int64())])


def _infill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for batch in batches:
        for part in slices(batch, "text"):
            buf, off = utf8(part.column("text"))
            end, cut = boundaries(buf, off)
            rows = []
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                whole = buf[off[i]:off[i + 1]]
                text = whole.tobytes()
                n = int(cut[i + 1] - cut[i])
                h1, h2, h3, h4 = draws(doc)
                if not text or any(x in text for x in (p, s, m)) or h3 % 100 >= FIM_PERCENT:
                    rows.append((doc, n, "plain", None, None, text, None))
                    continue
                index = RankIndex(np.concatenate([[0], end[cut[i]:cut[i + 1]] - off[i]]))
                a, b = sorted((index[h1 % (n + 1)], index[h2 % (n + 1)]))
                form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
                out = ((s, text[b:], p, text[:a], m, text[a:b]) if form == "spm"
                       else (p, text[:a], s, text[b:], m, text[a:b]))
                rows.append((doc, n, form, _code_points(whole[:a]), _code_points(whole[a:b]),
                             b"".join(out), len(index.first)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)


def infill(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, segments) per row; ``segments``
    is the size of the index, null where nothing was looked up."""
    out = with_columns_of(docs, {"doc_id": "long", "text": "string"}).mapInArrow(
        _infill, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                 "output binary, segments long")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from the output and its form alone. No part holds
    a sentinel and no sentinel overlaps itself, so each stands in the output once."""
    def head(mark):  # after the opening sentinel, up to the second one
        return F.substring(F.substring_index(output, mark, 1), len(PREFIX) + 1, 0x7FFFFFFF)

    def parts(mark):
        rest = F.substring_index(output, mark, -1)
        return F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)
    suffix, middle_psm = parts(SUFFIX)
    prefix, middle_spm = parts(PREFIX)
    return (F.when(form == "psm", F.concat(head(SUFFIX), middle_psm, suffix))
            .when(form == "spm", F.concat(prefix, middle_spm, head(PREFIX)))
            .otherwise(output))


def op12(docs: DataFrame) -> DataFrame:
    """Contract of op12_infill."""
    return infill(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
         greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM w),
p AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(w[b + 1:], ''), '') AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
