"""Benchmark decontamination (operator 8): SimHash of item-sized windows, a
multi-index of Hamming blocks, exact weighted-shingle similarity.

Words are lower-cased runs of letters and digits; shingles take five words (a
shorter item is one shingle of all its words). A document's windows have the
word count of an item. A window without a shingle of any item has similarity 0
with all of them, so windows are placed where an item's shingle occurs, aligned
with its place in the item; each gets a 128-bit SimHash of its weighted
shingles. Fingerprints are split into RADIUS + 1 blocks: two of them within
RADIUS agree in one block at least, so the block index finds every item
fingerprint within RADIUS. Those are verified by the exact weighted Jaccard
similarity (weights: log(1 + items / items with the shingle), counted over the whole
benchmark), 0.8 or more.
A pair at 0.8 differs in 19 bits on average; over 36 has a chance below 1e-4.

Items are taken in blocks of at most ITEM_BLOCK (about), each a stated query set that is
sent to all tasks; all documents are scanned whole against each block.

Rows: null or blank texts of items or documents match nothing. Repeated items
and documents give their own rows. Null ids are kept. Extra columns are ignored
by the search and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (mix, prefix_hashes, shingle_hashes, slices, span_hash, utf8, with_columns_of,
                     word_spans)

K, THRESHOLD = 5, 0.8
BITS, RADIUS = 128, 36
ITEM_BLOCK = 20_000
_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_EDGES = np.linspace(0, BITS, RADIUS + 2).round().astype(int)


def _words(col: pa.Array):
    """Word hashes, their rows, and row offsets into the words."""
    buf, off = utf8(pc.utf8_lower(col.cast(pa.large_string())))
    start, end, row = word_spans(buf, off, _SEP)
    return (span_hash(prefix_hashes(buf), start, end), row,
            np.searchsorted(row, np.arange(len(off))))


def _bits(h: np.ndarray) -> np.ndarray:
    """(n, BITS) of -1 and 1."""
    both = np.stack([h, mix(h ^ np.uint64(0x5851F42D4C957F2D))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _simhash(h: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(windows, BITS) bools: the signs of the weighted sums from each start in ``at``. The angle goes
    by squared weights, so their roots make it follow the weighted Jaccard similarity."""
    return np.add.reduceat(_bits(h) * np.sqrt(w)[:, None].astype(np.float32), at, 0) > 0


def _block_keys(fp: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows, blocks): word count, block number and the block's bits in one key."""
    out = np.zeros((len(fp), RADIUS + 1), np.uint64)
    for b in range(RADIUS + 1):
        v = np.zeros(len(fp), np.uint64)
        for j in range(_EDGES[b], _EDGES[b + 1]):
            v = v * np.uint64(2) + fp[:, j]
        out[:, b] = (n.astype(np.uint64) << np.uint64(16)) + np.uint64(b << 8) + v
    return out


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with lo[i] <= j < hi[i]."""
    size = hi - lo
    i = np.repeat(np.arange(len(lo)), size)
    j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    return i, j


def _item_sets(col: pa.Array) -> list[np.ndarray]:
    """The shingles of each text that has words."""
    word, _, cut = _words(col)
    return [shingle_hashes(word[a:b], np.zeros(b - a, np.int64), K)[0] for a, b in zip(cut, cut[1:]) if b > a]


def _repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one set, in order, and how many hold them."""
    h, n = np.unique(np.concatenate([np.unique(s) for s in sets]) if sets else np.zeros(0, np.uint64), return_counts=True)
    return h[n > 1], n[n > 1]


class Items:
    """One block of benchmark items: shingles, weights, fingerprints and their index.

    ``repeated`` are the shingles that several items of the whole benchmark hold, with the number
    of items, and ``total`` the number of its items; all others count as held by one."""

    def __init__(self, ids: list, texts: list, repeated: tuple[np.ndarray, np.ndarray] | None = None, total: int = 0):
        word, row, cut = _words(pa.array(texts, pa.string()))
        n = np.diff(cut)
        full = np.flatnonzero(n)
        self.ids = [ids[i] for i in full]
        self.n = n[full]
        sets = []
        for i in full:
            w = word[cut[i]:cut[i + 1]]
            sets.append(shingle_hashes(w, np.zeros(len(w), np.int64), K)[0])
        self.sets = sets
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.concatenate([np.arange(len(s)) for s in sets]) if sets else owner
        if repeated is None:  # these items are the whole benchmark
            repeated, total = _repeated(sets), len(sets)
        self.known = repeated[0]
        self.weight = np.log1p(total / repeated[1])
        self.rare = np.log1p(max(1, total))
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.place = flat[order], owner[order], place[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.flat & np.uint64((1 << 20) - 1)] = True
        self.sizes = sorted({min(K, int(x)) for x in self.n})
        if sets:
            at = np.cumsum([0, *[len(s) for s in sets]])[:-1]
            f = np.concatenate(sets)
            self.fp = _simhash(f, self.weigh(f), at)
            keys = _block_keys(self.fp, self.n)
            order = np.argsort(keys.reshape(-1), kind="stable")
            self.keys, self.posting = keys.reshape(-1)[order], order // (RADIUS + 1)

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(h), self.rare)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.weight[at], self.rare)

    def similarity(self, h: np.ndarray, item: int) -> float:
        """Weighted Jaccard of two bags of shingles."""
        u, inv = np.unique(np.concatenate([h, self.sets[item]]), return_inverse=True)
        a = np.bincount(inv[:len(h)], minlength=len(u))
        b = np.bincount(inv[len(h):], minlength=len(u))
        w = self.weigh(u)
        return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())

    def find(self, col: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, Hamming distance, similarity): the best window of each row and item."""
        word, row, cut = _words(col)
        best: dict = {}
        for k in self.sizes:
            self._find(word, row, cut, k, best)
        return [(r, i, *v) for (r, i), v in best.items()]

    def _find(self, word, row, cut, k, best) -> None:
        if not len(word):
            return
        n_doc = np.diff(cut)
        h, hrow = shingle_hashes(word, row, k)
        first = np.concatenate([[0], np.cumsum(np.where(n_doc > 0, np.maximum(n_doc - k + 1, 1), 0))])
        maybe = np.flatnonzero(self.bitmap[h & np.uint64((1 << 20) - 1)])
        lo, hi = (np.searchsorted(self.flat, h[maybe], s) for s in ("left", "right"))
        i, j = _expand(lo, hi)
        fits = np.minimum(self.n[self.owner[j]], K) == k
        i, j = maybe[i[fits]], j[fits]
        if not len(i):
            return
        doc = hrow[i]
        start = i - first[doc] - self.place[j]
        size = self.n[self.owner[j]]
        # an item-sized window, moved inside the document where it is long enough
        start = np.clip(start, 0, np.maximum(n_doc[doc] - size, 0))
        win = np.unique(np.stack([doc, start, size], 1), axis=0)
        for c in range(0, len(win), 2000):
            self._match(win[c:c + 2000], h, first, n_doc, k, best)

    def _match(self, win, h, first, n_doc, k, best) -> None:
        doc, start, size = win.T
        lo = first[doc] + start
        hi = lo + np.maximum(np.minimum(size, n_doc[doc]) - k + 1, 1)
        hi = np.minimum(hi, first[doc + 1])
        w, at = _expand(lo, hi)
        flat = h[at]
        begin = np.searchsorted(w, np.arange(len(win)))
        fp = _simhash(flat, self.weigh(flat), begin)
        keys = _block_keys(fp, size)
        a, b = (np.searchsorted(self.keys, keys.reshape(-1), s) for s in ("left", "right"))
        x, y = _expand(a, b)
        pairs = np.unique(np.stack([x // (RADIUS + 1), self.posting[y]], 1), axis=0)
        far = (fp[pairs[:, 0]] != self.fp[pairs[:, 1]]).sum(1)
        for (v, item), d in zip(pairs[far <= RADIUS], far[far <= RADIUS]):
            sim = self.similarity(h[lo[v]:hi[v]], item)
            if sim >= THRESHOLD:
                key = (int(doc[v]), int(item))
                new = (int(start[v]), int(d), sim)
                if key not in best or (new[2], -new[0]) > (best[key][2], -best[key][0]):
                    best[key] = new


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (shingle) of each item once, and a null for the item itself."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [np.unique(s) for s in _item_sets(part.column("text"))]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(flat.view(np.int64)), pa.nulls(len(sets), pa.int64())])], ["shingle"])


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks by hash; a block is a bounded query set. Weights are those of the whole
    benchmark: one grouped count gives the shingles that several items hold, which are fewer than half of its shingles."""
    b = with_columns_of(benchmark, {"item_id": "long", "text": "string"}).where("text is not null")
    counts = b.select("text").mapInArrow(_shingle_rows, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    got = counts.where("n > 1 OR shingle IS NULL").select(  # a long column with a null would come as doubles
        F.coalesce("shingle", F.lit(0)).alias("shingle"), F.col("shingle").isNull().alias("items"), "n").toPandas()
    items = got["items"].to_numpy(bool)
    total = int(got["n"][items].sum())
    known, n = got["shingle"].to_numpy(np.int64)[~items].view(np.uint64), got["n"].to_numpy(np.int64)[~items]
    order = np.argsort(known)
    repeated = known[order], n[order]
    blocks = max(1, -(-b.count() // ITEM_BLOCK))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for i in range(blocks):
        rows = b.where(part == i).collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], repeated, total)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, hamming, similarity): per document row and item
    that it contains, the best window."""
    d = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    out = None
    for items in item_blocks(benchmark):
        def run(batches, items=items):
            for batch in batches:
                for part in slices(batch, "text"):
                    got = items.find(part.column("text"))
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r] for r, *_ in got], pa.int64()),
                         pa.array([items.ids[i] for _, i, *_ in got], pa.int64()),
                         pa.array([s for _, _, s, _, _ in got], pa.int64()),
                         pa.array([int(items.n[i]) for _, i, *_ in got], pa.int64()),
                         pa.array([x[3] for x in got], pa.int64()),
                         pa.array([x[4] for x in got], pa.float64())],
                        ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"])
        part = d.mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, "
                                 "hamming long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that contain no benchmark item, all columns as they were."""
    for items in item_blocks(benchmark):
        def run(batches, items=items):
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, *_ in items.find(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
