"""Toxicity scoring (operator 10): gradient-boosted trees over dense features with
isotonic calibration.

Features of a whole text: densities of a fixed and a learned lexicon, lexicon
words near second-person words, capitals, punctuation and obfuscation rates.
The learned lexicon holds word prefixes and words that occur far more often in
toxic than in clean training texts; it makes the scorer work in languages for
which no list is given. Learning uses at most ``MAX_TRAIN`` labelled rows
(chosen by a hash of the id) and ``MAX_TERMS`` candidate terms; scoring covers
every row and the whole text.

Training is cross-fitted: a row's lexicon features and its calibration score
come from models that have not seen the row.

Rows: a null text counts as empty and is scored. Of several rows of an id the smallest
text is learned from. Labels that are null are ignored, repeated labels of an id count as toxic if any is. With no labelled
rows, or one class only, every score is the share of toxic labels (0 if none).
A null ``doc_id`` is never a training row. Other columns are ignored by the
scorer and kept by ``drop_toxic``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ascii_lower, materialise, mix, prefix_hashes, slices, span_hash, utf8,
                     with_columns_of, word_spans)

MAX_TRAIN = 30_000
MAX_TERMS = 50_000
MAX_LEXICON = 5_000
MIN_TOXIC = 3
PREFIXES = (4, 5, 6, 7, 8, 10)
NEAR = 6

#: Insults in English; a small public-domain style list.
LEXICON = ("idiot idiots moron morons stupid loser losers pathetic trash scum worthless disgusting "
           "clown clowns dumb fool jerk garbage imbecile hate kill shut vermin filth").split()
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deinen ihr euch sie ihnen "
                 "tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros").split()

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 36, 64]] = True  # letters, digits, $ and @
_SEP = ~_WORD
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$", b"oieastas"):
    _LEET[_a] = _b
N_FEATURES = 20


class Terms:
    """Hash -> weight with a bitmap in front."""

    def __init__(self, keys, weights):
        order = np.argsort(keys)
        self.keys, self.weights = np.asarray(keys, np.uint64)[order], np.asarray(weights, np.float64)[order]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self.keys & np.uint64((1 << 18) - 1)] = True

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms, and their places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[h & np.uint64((1 << 18) - 1)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == h[maybe]
        return maybe[ok], at[ok]

    def weigh(self, h: np.ndarray, into: np.ndarray, which: np.ndarray | None = None) -> None:
        hit, at = self.place(h)
        if len(hit):
            to = hit if which is None else which[hit]
            into[to] = np.maximum(into[to], self.weights[at])


def _words_of(names) -> Terms:
    keys = []
    for w in names:
        b = np.frombuffer(w.encode(), np.uint8)
        keys.append(span_hash(prefix_hashes(b), np.array([0]), np.array([len(b)]))[0])
    return Terms(np.array(keys, np.uint64), np.ones(len(keys)))


def term_hashes(h, start, end):
    """(hashes, word numbers) of each word's prefixes and of the word itself."""
    size = end - start
    for k in PREFIXES:
        use = np.flatnonzero(size >= k)
        yield mix(span_hash(h, start[use], start[use] + k) + np.uint64(k)), use
    yield span_hash(h, start, end), np.arange(len(start))


def features(col: pa.Array, lex: Terms, fixed: Terms, person: Terms) -> np.ndarray:
    """(rows, N_FEATURES) float32 over whole texts."""
    buf, off = utf8(col)
    rows = len(off) - 1
    low = ascii_lower(buf)
    start, end, row = word_spans(low, off, _SEP)
    n = np.bincount(row, minlength=rows).astype(np.float64)
    h = prefix_hashes(low)
    w = np.zeros(len(start))
    for hashes, use in term_hashes(h, start, end):
        lex.weigh(hashes, w, use)
    whole = span_hash(h, start, end)
    fx, you = np.zeros(len(start)), np.zeros(len(start))
    fixed.weigh(whole, fx)
    person.weigh(whole, you)
    leet = _LEET[low]
    odd = np.flatnonzero(np.concatenate([[0], np.cumsum(leet != low)])[end]
                         > np.concatenate([[0], np.cumsum(leet != low)])[start])
    lt = np.zeros(len(start))
    if len(odd):
        hl, so, eo = prefix_hashes(leet), start[odd], end[odd]
        got = np.zeros(len(odd))
        for hashes, use in term_hashes(hl, so, eo):
            lex.weigh(hashes, got, use)
        fixed.weigh(span_hash(hl, so, eo), got)
        lt[odd] = np.where((w[odd] == 0) & (fx[odd] == 0), got, 0)
    bad = (w > 0) | (fx > 0) | (lt > 0)
    near = np.zeros(len(start), bool)
    if you.any() and bad.any():
        c = np.concatenate([[0], np.cumsum(you > 0)])
        i = np.arange(len(start))
        lo = np.maximum(i - NEAR, np.searchsorted(row, row))
        hi = np.minimum(i + NEAR + 1, np.searchsorted(row, row, "right"))
        near = bad & (c[hi] > c[lo])

    def per(v):
        return np.bincount(row, weights=v, minlength=rows)

    def bytes_of(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off[1:]] - c[off[:-1]]).astype(np.float64)

    def top(v):
        out = np.zeros(rows)
        np.maximum.at(out, row[v > 0], v[v > 0])
        return out
    letters = _LETTER[buf]
    upper = (buf >= 65) & (buf <= 90)
    digit = (buf >= 48) & (buf <= 57)
    cl = np.concatenate([[0], np.cumsum(letters)])
    cu = np.concatenate([[0], np.cumsum(upper)])
    nl = cl[end] - cl[start]
    shout = (cu[end] - cu[start] == end - start) & (end - start >= 3)
    mixed = (nl > 0) & (nl < end - start)
    punct = _SEP[buf] & (buf > 32)
    run = punct.copy()
    run[1:] &= buf[1:] == buf[:-1]
    if len(run):
        run[0] = False
    nb = np.maximum(off[1:] - off[:-1], 1).astype(np.float64)
    nw = np.maximum(n, 1)
    x = np.zeros((rows, N_FEATURES), np.float32)
    cols = [np.log1p(n), top(w), per(w > 0), per(w > 0) / nw, per(w), per(w > 3), per(fx), per(fx) / nw,
            top(lt), per(lt > 0), per(you) / nw, per(near), per(near) / nw,
            bytes_of(upper) / np.maximum(bytes_of(letters), 1), per(shout) / nw, bytes_of(buf == 33) / nb,
            bytes_of(punct) / nb, bytes_of(run) / nb, per(mixed) / nw, bytes_of(digit) / nb]
    for i, v in enumerate(cols):
        x[:, i] = v
    return x


# --- gradient-boosted trees -------------------------------------------------

def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.15,
              bins: int = 48, l2: float = 1.0) -> dict:
    """Second-order boosting of complete trees on quantile bins; ties take the first split."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(len(y), base)
    trees = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feat, thr = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for d in range(depth):
            m = 1 << d
            best = np.full(m, 1e-6)
            pick = np.full((m, 2), -1)
            sg, sh = np.bincount(node, g, m), np.bincount(node, h, m)
            for f, c in enumerate(cuts):
                k = len(c) + 1
                if k < 2:
                    continue
                at = node * k + code[:, f]
                gl = np.bincount(at, g, m * k).reshape(m, k).cumsum(1)[:, :-1]
                hl = np.bincount(at, h, m * k).reshape(m, k).cumsum(1)[:, :-1]
                gain = (gl ** 2 / (hl + l2) + (sg[:, None] - gl) ** 2 / (sh[:, None] - hl + l2)
                        - (sg ** 2 / (sh + l2))[:, None])
                gain[(hl < 0.5) | (sh[:, None] - hl < 0.5)] = 0
                j = gain.argmax(1)
                v = gain[np.arange(m), j]
                better = v > best
                best[better] = v[better]
                pick[better, 0], pick[better, 1] = f, j[better]
            right = np.zeros(len(y), bool)
            for i in range(m):
                f, j = pick[i]
                if f >= 0:
                    feat[m - 1 + i], thr[m - 1 + i] = f, cuts[f][j]
                    mine = node == i
                    right[mine] = code[mine, f] > j
            node = node * 2 + right
        leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
        score += leaf[node]
        trees.append((feat, thr, leaf))
    return {"base": base, "trees": trees}


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    s = np.full(len(x), model["base"])
    i = np.arange(len(x))
    for feat, thr, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(leaf)))):
            node = 2 * node + 1 + (x[i, feat[node]] > thr[node])
        s += leaf[node - (len(leaf) - 1)]
    return s


def fit_isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots (mean score, rate) of the pooled blocks."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []  # sum y, count, sum s
    for a, b in zip(s[order], y[order]):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            z = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], z)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


# --- learning -----------------------------------------------------------

def _toxic_terms():
    """(text, fold) of toxic rows -> (term, fold, rows) partial counts."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = utf8(part.column("text"))
                low = ascii_lower(buf)
                start, end, row = word_spans(low, off, _SEP)
                h = prefix_hashes(low)
                fold = part.column("fold").to_numpy()
                out = [[], []]
                cut = np.searchsorted(row, np.arange(len(off)))
                for i in range(len(off) - 1):
                    a, b = cut[i], cut[i + 1]
                    terms = np.unique(np.concatenate([t for t, _ in term_hashes(h, start[a:b], end[a:b])]))
                    out[fold[i]].append(terms)
                for f in (0, 1):
                    if out[f]:
                        t, c = np.unique(np.concatenate(out[f]), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(t.view(np.int64)), pa.array(np.full(len(t), f)), pa.array(c)],
                            ["term", "fold", "n"])
    return run


def _clean_counts(keys: np.ndarray):
    """(text, fold) of clean rows -> rows holding each candidate term, per task and fold."""
    def run(batches):
        terms = Terms(keys, np.ones(len(keys)))
        n = np.zeros((2, len(keys)), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = utf8(part.column("text"))
                low = ascii_lower(buf)
                start, end, row = word_spans(low, off, _SEP)
                h = prefix_hashes(low)
                fold = part.column("fold").to_numpy()
                seen = []
                for hashes, use in term_hashes(h, start, end):
                    hit, at = terms.place(hashes)
                    seen.append(np.unique(row[use[hit]] * np.int64(len(keys) + 1) + at))
                seen = np.unique(np.concatenate(seen))
                r, t = seen // (len(keys) + 1), seen % (len(keys) + 1)
                np.add.at(n, (fold[r], t), 1)
        for f in (0, 1):
            use = np.flatnonzero(n[f])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.keys[use].view(np.int64)), pa.array(np.full(len(use), f)),
                 pa.array(n[f][use])], ["term", "fold", "n"])
    return run


def _lexicon(tox: np.ndarray, clean: np.ndarray, keys: np.ndarray, n_tox: int, n_clean: int) -> Terms:
    """Terms whose cautious log odds pass 2: the counts are moved by one standard error against them."""
    odds = (np.log((np.maximum(tox - np.sqrt(tox), 0) + 0.5) / (n_tox + 1))
            - np.log((clean + np.sqrt(clean) + 0.5) / (n_clean + 1)))
    use = np.flatnonzero((odds > 2) & (tox >= MIN_TOXIC))
    use = use[np.argsort(-odds[use], kind="stable")][:MAX_LEXICON]
    return Terms(keys[use], odds[use])


def _feature_rows(lexicons: list[Terms], fixed: Terms, person: Terms):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fold = part.column("fold").to_numpy()
                x = [features(part.column("text"), lex, fixed, person) for lex in lexicons]
                use = np.where((fold == 0)[:, None], x[1], x[0])  # the other fold's lexicon
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in use]), part.column("toxic"), part.column("fold")],
                    ["x", "toxic", "fold"])
    return run


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Model learned from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    d = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    lab = with_columns_of(labels, {"doc_id": "long", "toxic": "int"}).dropna().where(
        ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = lab.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(MAX_TRAIN).select(
        "doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("long").alias("fold"))
    rows = sample.toPandas()  # at most MAX_TRAIN ids, so the join below may broadcast them
    spark = docs.sparkSession
    sample = spark.createDataFrame(rows.astype({"toxic": "int64"}) if len(rows) else [],
                                   "doc_id long, toxic long, fold long")
    # one row an id: what is learned from stays bounded, and the documents are scanned once for it
    train = materialise(d.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "fold").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text")), "toxicity-train")
    share = float(rows["toxic"].mean()) if len(rows) else 0.0
    if not 0 < share < 1:
        return {"share": share}
    n = np.array([[int(((rows.toxic == t) & (rows.fold == f)).sum()) for f in (0, 1)] for t in (0, 1)])
    sums = F.sum(F.when(F.col("fold") == 0, F.col("n")).otherwise(0)), F.sum(
        F.when(F.col("fold") == 1, F.col("n")).otherwise(0))
    tox = (train.where("toxic = 1").select("text", "fold").mapInArrow(
        _toxic_terms(), "term long, fold long, n long").groupBy("term")
        .agg(sums[0].alias("t0"), sums[1].alias("t1")).where(F.col("t0") + F.col("t1") >= MIN_TOXIC)
        .orderBy(-(F.col("t0") + F.col("t1")), "term").limit(MAX_TERMS).toPandas())
    keys = tox["term"].to_numpy(np.int64).view(np.uint64)
    got = train.where("toxic = 0").select("text", "fold").mapInArrow(
        _clean_counts(keys), "term long, fold long, n long").groupBy("term").agg(
        sums[0].alias("c0"), sums[1].alias("c1")).toPandas()  # at most MAX_TERMS rows
    tox = tox.merge(got, "left", "term").fillna(0)
    t, c = tox[["t0", "t1"]].to_numpy(float), tox[["c0", "c1"]].to_numpy(float)
    keys = tox["term"].to_numpy(np.int64).view(np.uint64)
    halves = [_lexicon(t[:, f], c[:, f], keys, n[1, f], n[0, f]) for f in (0, 1)]
    lex = _lexicon(t.sum(1), c.sum(1), keys, n[1].sum(), n[0].sum())
    fixed, person = _words_of(LEXICON), _words_of(SECOND_PERSON)
    got = train.select("text", "toxic", "fold").mapInArrow(
        _feature_rows(halves, fixed, person), "x binary, toxic long, fold long").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES)
    y, fold = got["toxic"].to_numpy(float), got["fold"].to_numpy()
    if not 0 < y.sum() < len(y):  # labels whose documents are missing
        return {"share": share}
    order = np.lexsort((*x.T, y, fold))  # the same model whatever order tasks ended in
    x, y, fold = x[order], y[order], fold[order]
    out = np.zeros(len(y))
    for f in (0, 1):
        mine = fold == f
        if mine.any() and not mine.all():
            out[mine] = raw_scores(fit_trees(x[~mine], y[~mine]), x[mine])
    return {"share": share, "lexicon": lex, "fixed": fixed, "person": person,
            "trees": fit_trees(x, y), "knots": fit_isotonic(out, y)}


def score_column(model: dict, col: pa.Array) -> np.ndarray:
    if "trees" not in model:
        return np.full(len(col), model["share"])
    x = features(col, model["lexicon"], model["fixed"], model["person"])
    return np.clip(np.interp(raw_scores(model["trees"], x), *model["knots"]), 0, 1)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) per row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score_column(model, part.column("text")))],
                    ["doc_id", "score"])
    return with_columns_of(docs, {"doc_id": "long", "text": "string"}).mapInArrow(
        run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows scored below the threshold, all columns as they were."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(score_column(model, part.column("text")) < threshold))
    return docs.mapInArrow(run, docs.schema)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of op10_toxicity."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", is_held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
