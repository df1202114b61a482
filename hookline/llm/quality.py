"""Quality scoring (operator 11): a support vector machine on naive Bayes features.

Terms are indicators of n-grams: 1 to 3 bytes; 2 to 4 signs of the text's shape
(letters, digits and white space folded to one sign each and runs to one, other
signs as they are); words and word pairs; and up to three answers to "is this word
the one before?". An indicator is scaled by its log-count ratio

    r = log((1 + good rows with it) / (2 + good rows)) - log((1 + bad rows with it) / (2 + bad rows))

and a row's vector brought to unit length. A linear model with hinge loss is
fitted by dual coordinate descent: one coordinate, the multiplier of one row, is
solved exactly at a time until the projected gradients of a whole pass differ by
less than a tolerance. A logistic curve fitted on margins of models that have
not seen the row turns margins into probabilities.

Learning takes at most ``MAX_TRAIN`` labelled rows, chosen by a hash of the id, and
the ``MAX_TERMS`` terms whose ratio stands out most from its standard error.
Terms are counted by a grouped aggregate; the driver gets at most ``MAX_TERMS``
counts and, for each training row, two bytes a term it holds. Every row is
scored, over its whole text.

Rows: a null text counts as empty and is scored (it holds no term, so its margin is
the intercept). Null labels are ignored, repeated labels of an id count as good only if all are. Of
repeated rows of an id in the sample the smallest text is learned from. With no labelled rows,
or one class only, every score is the share of good labels (0.5 if none). A null
``doc_id`` is never a training row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ascii_lower, materialise, mix, prefix_hashes, slices, span_hash, utf8,
                     with_columns_of, word_spans)

MAX_TRAIN = 10_000
MAX_TERMS = 30_000
MIN_ROWS = 5
#: A term takes part in a model if its log-count ratio is that many standard errors from 0.
MIN_Z = 3.0
PENALTY = 1.0
HALVES = 2
#: Bytes of a text that are hashed at a time, and counts that a task keeps before it sends them on.
WINDOW = 1 << 20
HELD = 2_000_000

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[128:] = ord("a")
for _low, _high, _as in ((97, 122, "a"), (65, 90, "A"), (48, 57, "0")):
    _SHAPE[_low:_high + 1] = ord(_as)
_SHAPE[[9, 10, 11, 12, 13, 32]] = 32


def byte_grams(buf: np.ndarray, off: np.ndarray, sizes: range, tag: int):
    """(hashes, rows, which count) of all runs of so many bytes inside a row, window by window;
    the windows of a long text overlap by what a run needs, so a run may come twice."""
    for at in range(0, max(len(buf), 1), WINDOW):
        part = buf[at:at + WINDOW + sizes[-1] - 1]
        n = len(part)
        ends = np.clip(off[1:], at, at + n) - at
        starts = np.clip(off[:-1], at, at + n) - at
        row = np.repeat(np.arange(len(ends), dtype=np.int32), ends - starts)
        left = np.repeat(ends, ends - starts) - np.arange(n)  # bytes from here to the end of the row or window
        gram = np.zeros(n, np.uint64)
        for k in range(1, min(sizes[-1], n) + 1):
            gram[:n - k + 1] |= part[k - 1:].astype(np.uint64) << np.uint64(8 * (k - 1))
            if k in sizes:
                yield mix(gram + np.uint64((tag + k) << 40)), row, left >= k


def shapes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded signs of each row, runs of one sign as one."""
    s = _SHAPE[buf]
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[off[:-1][off[:-1] < len(s)]] = True
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word, from windows of whole words."""
    h, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        to = max(int(np.searchsorted(end, start[at] + WINDOW, "right")), at + 1)
        a = start[at]
        h[at:to] = span_hash(prefix_hashes(low[a:end[to - 1]]), start[at:to] - a, end[at:to] - a)
        at = to
    return h


def word_grams(buf: np.ndarray, off: np.ndarray):
    low = ascii_lower(buf)
    start, end, row = word_spans(low, off)
    h = word_hashes(low, start, end)
    yield mix(h + np.uint64(1)), row, None
    pair = np.flatnonzero(row[1:] == row[:-1])
    yield mix(mix(h[pair]) + h[pair + 1]), row[pair], None
    # is the word the one before? asked of one, two and three words in a row
    answer, of = (h[pair] == h[pair + 1]).astype(np.uint64), row[pair]
    code, last = answer, np.arange(len(pair))
    for k in range(3):
        yield mix(code + np.uint64((k + 1) << 50)), of[last], None
        more = np.flatnonzero(last + 1 < len(pair))
        more = more[of[last[more] + 1] == of[last[more]]]
        code, last = code[more] * np.uint64(2) + answer[last[more] + 1], last[more] + 1


def families(col: pa.Array) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]]:
    """The terms of all rows, family by family, as pieces of (hashes, rows, which of them count;
    None: all); within a family a term may come more than once a row."""
    buf, off = utf8(col)
    yield byte_grams(buf, off, range(1, 4), 0)
    yield byte_grams(*shapes(buf, off), range(2, 5), 16)
    yield word_grams(buf, off)


class Vocabulary:
    """Sorted term hashes behind a table of their top bits; a hash whose place is taken is looked up by search."""

    SHIFT = np.uint64(44)

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(np.asarray(keys, np.uint64))
        n = len(self.keys)
        place = (self.keys >> self.SHIFT).astype(np.intp)
        self.first = np.full(1 << 20, n, np.int32)
        self.first[place[::-1]] = np.arange(n, dtype=np.int32)[::-1]  # the smallest key of a place stays
        self.more = np.zeros(1 << 20, bool)
        self.more[place[1:][place[1:] == place[:-1]]] = True
        self.wall = np.append(self.keys, ~np.uint64(0))  # what no place holds equals no hash

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms, and which terms."""
        place = (h >> self.SHIFT).astype(np.intp)
        at = self.first[place]
        hit = np.flatnonzero((self.wall[at] == h) & (at < len(self.keys)))
        rest = np.flatnonzero(self.more[place])
        to = np.minimum(np.searchsorted(self.keys, h[rest]), len(self.keys) - 1)
        ok = (self.keys[to] == h[rest]) & (to != at[rest])
        return np.concatenate([hit, rest[ok]]), np.concatenate([at[hit], to[ok]])

    def held(self, col: pa.Array) -> np.ndarray:
        """(rows, terms) indicators."""
        out = np.zeros((len(col), len(self.keys)), bool)
        if not len(self.keys):
            return out
        for family in families(col):
            for h, row, ok in family:
                hit, term = self.find(h)
                if ok is not None:
                    hit, term = hit[ok[hit]], term[ok[hit]]
                out[row[hit], term] = True
        return out


def blocks(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes and rows, so that a block of indicators stays small."""
    for part in slices(batch, "text"):
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


# --- the model ----------------------------------------------------------------

def log_ratios(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    return np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2))


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, value: np.ndarray, c: float = PENALTY,
              tolerance: float = 0.05, max_passes: int = 1000, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent of  |w|^2 / 2 + c * sum(max(0, 1 - y (w x + b)))  with the
    intercept as one more weight. ``rows[i]`` are the terms of row i, whose components are
    ``value[terms]`` brought to unit length; ``y`` is +1 or -1."""
    w, b = np.zeros(len(value)), 0.0
    scale = np.array([1 / max(np.sqrt((value[r] ** 2).sum()), 1e-12) for r in rows])
    q = np.array([2.0 if value[r].any() else 1.0 for r in rows])  # |x|^2 with the intercept's 1
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(max_passes):
        low, high = np.inf, -np.inf
        for i in rng.permutation(len(rows)):
            x = value[rows[i]] * scale[i]
            g = y[i] * (w[rows[i]] @ x + b) - 1
            bounded = min(g, 0) if alpha[i] == 0 else max(g, 0) if alpha[i] == c else g
            low, high = min(low, bounded), max(high, bounded)
            if bounded:
                new = min(max(alpha[i] - g / q[i], 0), c)
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x
                b += step
                alpha[i] = new
        if high - low < tolerance:
            break
    return w, b


def margins(rows: list[np.ndarray], value: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return np.array([(w[r] @ value[r]) / max(np.sqrt((value[r] ** 2).sum()), 1e-12) + b for r in rows])


def fit_sigmoid(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a s + b))) by Newton steps on targets drawn in from 0 and 1."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([s, np.ones(len(s))], 1)
    v = np.array([1.0, 0.0])

    def loss(v):
        z = x @ v
        return (np.logaddexp(0, z) - t * z).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ v)))
        g = x.T @ (p - t)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), g)
        size = 1.0
        while size > 1e-8 and loss(v - size * step) > loss(v) - 1e-4 * size * (g @ step):
            size /= 2
        v = v - size * step
        if np.abs(g).max() < 1e-6 * len(s):
            break
    return float(v[0]), float(v[1])


def chosen(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    r = log_ratios(good, bad, n_good, n_bad)
    return (np.abs(r) >= MIN_Z * np.sqrt(1 / (good + 1) + 1 / (bad + 1))) & (good + bad >= MIN_ROWS)


# --- learning -----------------------------------------------------------------

def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, by hash and row."""
    order = np.lexsort((row, h)) if len(row) and (np.diff(row) < 0).any() else np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[once], row[once]


def added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal hashes summed: (hashes, one row of cells each)."""
    keys, at = np.unique(h, return_inverse=True)
    return keys, np.stack([np.bincount(at, c, len(keys)) for c in n.T], 1)


def _term_counts(batches):
    """(text, good, half) -> rows that hold each term, by half and class, summed within a task
    as far as ``HELD`` counts go."""
    hs, ns, held = [], [], 0
    cells = 2 * HALVES

    def out():
        h, n = added(np.concatenate(hs), np.concatenate(ns))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[pa.array(c) for c in n.T]],
                                          ["term", *[f"c{i}" for i in range(cells)]])
    for batch in batches:
        for part in slices(batch, "text"):
            cell = part.column("half").to_numpy() * 2 + part.column("good").to_numpy()
            for family in families(part.column("text")):
                pieces = [distinct(h, row) if ok is None else distinct(h[ok], row[ok]) for h, row, ok in family]
                if not pieces:
                    continue
                h, row = distinct(*[np.concatenate(x) for x in zip(*pieces)])
                if not len(h):
                    continue
                at = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
                n = np.bincount(at * cells + cell[row], minlength=(at[-1] + 1) * cells).reshape(-1, cells)
                hs.append(h[np.flatnonzero(np.diff(at, prepend=-1))])
                ns.append(n.astype(np.float64))
                held += len(n)
            if held > HELD:
                yield out()
                hs, ns, held = [], [], 0
    if hs:
        yield out()


def _term_rows(vocabulary: Vocabulary):
    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                held = vocabulary.held(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("good"), part.column("half"),
                     pa.array([np.flatnonzero(r).astype(np.uint16).tobytes() for r in held], pa.binary())],
                    ["doc_id", "good", "half", "terms"])
    return run


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Model learned from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    spark = docs.sparkSession
    d = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    lab = with_columns_of(labels, {"doc_id": "long", "quality": "int"}).dropna().where(
        ~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    # at most MAX_TRAIN ids, so the join below may broadcast them
    sample = lab.orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(MAX_TRAIN).select(
        "doc_id", F.when(F.col("good") > 0, 1).otherwise(0).cast("long").alias("good"),
        F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(HALVES)).cast("long").alias("half")).toPandas()
    share = float(sample["good"].mean()) if len(sample) else 0.5
    if not 0 < share < 1:
        return {"share": share}
    train = materialise(
        d.join(F.broadcast(spark.createDataFrame(sample, "doc_id long, good long, half long")), "doc_id")
         .groupBy("doc_id", "good", "half").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "quality-train")
    sizes = {(r.half, r.good): r.n for r in train.groupBy("half", "good").agg(F.count("*").alias("n")).collect()}
    n = np.array([[sizes.get((f, g), 0) for g in (0, 1)] for f in range(HALVES)], float)
    if not n[:, 0].sum() or not n[:, 1].sum():  # labels whose documents are missing
        return {"share": share}
    cells = [f"c{i}" for i in range(2 * HALVES)]
    counts = train.select("text", "good", "half").mapInArrow(
        _term_counts, ", ".join(["term long", *[f"{c} double" for c in cells]])).groupBy("term").agg(
        *[F.sum(c).alias(c) for c in cells])
    good, bad = sum(F.col(c) for c in cells[1::2]), sum(F.col(c) for c in cells[::2])
    z = (F.abs(F.log((good + 1) / float(n[:, 1].sum() + 2)) - F.log((bad + 1) / float(n[:, 0].sum() + 2)))
         / F.sqrt(1 / (good + 1) + 1 / (bad + 1)))
    top = (counts.where(good + bad >= MIN_ROWS).withColumn("z", z).where(F.col("z") >= MIN_Z)
           .orderBy(F.desc("z"), "term").limit(MAX_TERMS).toPandas())
    top["key"] = top["term"].to_numpy(np.int64).view(np.uint64)
    top = top.sort_values("key")
    vocabulary = Vocabulary(top["key"].to_numpy())
    c = top[cells].to_numpy(float).reshape(-1, HALVES, 2)  # term, half, class
    got = train.mapInArrow(_term_rows(vocabulary), "doc_id long, good long, half long, terms binary").toPandas()
    got = got.sort_values("doc_id")  # the same model whatever order tasks ended in
    rows = [np.frombuffer(t, np.uint16) for t in got["terms"]]
    y, half = np.where(got["good"] > 0, 1.0, -1.0), got["half"].to_numpy()

    def model(use: np.ndarray):
        """Scaled values and weights learned from these halves alone."""
        of = [c[:, use, g].sum(1) for g in (1, 0)], [n[use, g].sum() for g in (1, 0)]
        value = np.where(chosen(*of[0], *of[1]), log_ratios(*of[0], *of[1]), 0.0)
        mine = np.flatnonzero(np.isin(half, use))
        return value, *fit_hinge([rows[i] for i in mine], y[mine], value)
    apart = np.zeros(len(y))
    for f in range(HALVES):
        others = np.array([x for x in range(HALVES) if x != f])
        if n[others].sum(0).all():
            mine = np.flatnonzero(half == f)
            apart[mine] = margins([rows[i] for i in mine], *model(others))
    value, w, b = model(np.arange(HALVES))
    return {"share": share, "vocabulary": vocabulary, "value": value, "weights": w, "intercept": b,
            "curve": fit_sigmoid(apart, (y > 0).astype(float))}


def score_column(model: dict, col: pa.Array) -> np.ndarray:
    if "weights" not in model:
        return np.full(len(col), model["share"])
    rows, terms = np.nonzero(model["vocabulary"].held(col))
    value = model["value"]
    length = np.sqrt(np.bincount(rows, (value * value)[terms], len(col)))
    s = np.bincount(rows, (model["weights"] * value)[terms], len(col)) / np.maximum(length, 1e-12) + model["intercept"]
    a, b = model["curve"]
    return 1 / (1 + np.exp(-np.clip(a * s + b, -500, 500)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) per row."""
    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score_column(model, part.column("text")))],
                    ["doc_id", "score"])
    return with_columns_of(docs, {"doc_id": "long", "text": "string"}).mapInArrow(
        run, "doc_id long, score double")


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of op11_quality."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", is_held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
