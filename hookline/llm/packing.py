"""Best-fit packing (operator 3): a configuration linear program over the length
histogram, solved by multiplicative weights with knapsack pricing, then rounded.

Texts are tokenised where they lie; from then on only piece lengths move. The
histogram (at most ``capacity`` rows) goes to the driver, where the program is
solved: its size depends on the capacity, not on the number of documents. The
solution is a list of runs, ``n`` sequences of one configuration each, which
gives every (length, rank) its place; ranks come from a two-level count over
(length, hash bucket), so a length shared by a third of all pieces is many
small groups.

Token ids are those of the ``tokenizers`` file named by ``tokenizer``, special
strings being ordinary text. Where the same vocabulary lies beside it as ranks
(same name, ``.tiktoken``) the ids are computed from those: they are equal and
come about seven times faster.

Rows: a null text is empty and gives one piece, the separator alone. Repeated
rows are packed as often as they occur; a null ``doc_id`` is kept. An empty
table packs nothing. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, with_columns_of

CAPACITY, SEPARATOR = 1024, 2
BUCKETS = 1024


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(tokenizer: str):
    """texts -> lists of ids."""
    ranks = os.path.splitext(tokenizer)[0] + ".tiktoken"

    @lru_cache(maxsize=1)
    def slow():
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        return t

    def by_file(text):
        return slow().encode(text, add_special_tokens=False).ids
    if not os.path.exists(ranks):
        return lambda texts: [by_file(t) for t in texts]
    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                             special_tokens={})

    def one(text):
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # its pattern gives up on some very long runs of one class, by a Rust panic
            return by_file(text)
    return lambda texts: [one(t) for t in texts]


def _pieces(tokenizer: str, capacity: int, separator: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(),
                                    encode([t or "" for t in part.column("text").to_pylist()])):
                    ids = np.array([*ids, separator], "<u4")
                    first = len(ids) % capacity or capacity  # only the first piece may be shorter
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                             for i, (a, b) in enumerate(zip(edges, edges[1:]))]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(),
                                                            pa.int64(), pa.int64()))], names)
    return run


# --- the program ----------------------------------------------------------

def _price(values: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Multiplicities (at most ``most``) of the best filled sequence: a 0/1 knapsack by dynamic
    programming over binary parts of the multiplicities."""
    kind, size, take = [], [], []
    left = np.minimum(most, capacity // sizes)
    part = 1
    while (left > 0).any():
        use = np.flatnonzero(left > 0)
        n = np.minimum(left[use], part)
        kind.append(use), take.append(n), size.append(n * sizes[use])
        left[use] -= n
        part *= 2
    kind, size, take = (np.concatenate(x) for x in (kind, size, take))
    fits = size <= capacity
    kind, size, take = kind[fits], size[fits], take[fits]
    gain = values[kind] * take
    best = np.zeros(capacity + 1)
    chosen = np.zeros((len(kind), capacity + 1), bool)
    for i, (s, g) in enumerate(zip(size.tolist(), gain.tolist())):
        with_it = best[:capacity + 1 - s] + g
        np.greater(with_it, best[s:], out=chosen[i, s:])
        np.maximum(best[s:], with_it, out=best[s:])
    out = np.zeros(len(sizes), np.int64)
    room = int(best.argmax())
    for i in range(len(kind) - 1, -1, -1):
        if chosen[i, room]:
            out[kind[i]] += take[i]
            room -= size[i]
    return out


def solve_fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int,
                     rate: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(configurations, amounts) that cover the demand, none of it twice.

    Prices start at size * (1 + size / capacity), as large pieces are the
    hardest to combine, and are multiplied by exp(-rate * share covered so
    far, compared with the mean). Each step prices a configuration of what is
    uncovered and adds as much of it as its scarcest size allows.
    """
    left = demand.astype(float)
    area = (sizes * demand).sum()
    prices = sizes * (1 + sizes / capacity)
    found: dict[bytes, int] = {}
    configs, amounts = [], []
    for _ in range(steps):
        use = np.flatnonzero(left > 1e-9)
        if not len(use):
            break
        ahead = 1 - left / demand - (1 - (sizes * left).sum() / area)
        a = np.zeros(len(sizes), np.int64)
        a[use] = _price((prices * np.exp(-rate * ahead))[use], sizes[use],
                        np.ceil(left[use] - 1e-9).astype(np.int64), capacity)
        used = a > 0
        amount = (left[used] / a[used]).min()
        key = a.tobytes()
        if key in found:
            amounts[found[key]] += amount
        else:
            found[key] = len(configs)
            configs.append(a), amounts.append(amount)
        left = np.maximum(left - amount * a, 0)
    return np.array(configs), np.array(amounts)


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: (sizes of a sequence, number of such sequences)."""
    open_: dict[int, dict[tuple, int]] = {}  # room -> contents -> sequences
    for s, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        while n:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                each = capacity // s
                full, rest = divmod(n, each)
                for k, m in ((each, full), (rest, 1 if rest else 0)):
                    if m:
                        g = open_.setdefault(capacity - k * s, {})
                        g[(s,) * k] = g.get((s,) * k, 0) + m
                n = 0
                continue
            contents, m = next(iter(open_[room].items()))
            k = min(m, n)
            if k == m:
                del open_[room][contents]
                if not open_[room]:
                    del open_[room]
            else:
                open_[room][contents] = m - k
            g = open_.setdefault(room - s, {})
            g[(*contents, s)] = g.get((*contents, s), 0) + k
            n -= k
    return [(list(c), m) for g in open_.values() for c, m in g.items()]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = 1500, rounds: int = 3
          ) -> list[tuple[list[int], int]]:
    """(sizes in a sequence, number of such sequences): all pieces of the histogram, packed.

    The amounts of the fractional solution are rounded down, as far as pieces
    are left, and what remains is solved again; the rest after ``rounds``, a
    few hundred sequences whatever the input, is packed best-fit decreasing.
    """
    out = [([capacity], histogram[capacity])] if histogram.get(capacity) else []
    left = {s: n for s, n in histogram.items() if n and s < capacity}
    for _ in range(rounds):
        if sum(left.values()) < 4 * len(left) or len(left) < 2:
            break
        sizes = np.array(sorted(left), np.int64)
        demand = np.array([left[s] for s in sizes.tolist()], np.int64)
        configs, amounts = solve_fractional(sizes, demand, capacity, steps)
        rest = demand.copy()
        for i in np.argsort(-amounts, kind="stable"):
            a = configs[i]
            used = a > 0
            n = min(int(amounts[i] + 1e-9), int((rest[used] // a[used]).min()))
            if n > 0:
                rest -= n * a
                out.append((np.repeat(sizes, a).tolist(), n))
        left = {s: n for s, n in zip(sizes.tolist(), rest.tolist()) if n}
    if left:
        sizes = np.array(sorted(left), np.int64)
        out += _best_fit(sizes, np.array([left[s] for s in sizes.tolist()], np.int64), capacity)
    return out


def runs_of(solution: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go: arrays (length, first rank, first sequence, offset) by
    length and rank. Rank first + i of a run goes to sequence first + i."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for sizes, n in solution:
        offset = 0
        for s in sizes:
            r = next_rank.get(s, 0)
            rows.append((s, r, sequence, offset))
            next_rank[s] = r + n
            offset += s
        sequence += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros((4, 0), np.int64))


def _placed(runs):
    length, rank, sequence, offset = runs
    key = (length << 44) + rank

    def run(batches):
        for b in batches:
            r = b.column("rank").to_numpy()
            at = np.searchsorted(key, (b.column("length").to_numpy() << 44) + r, "right") - 1
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    d = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    pieces = materialise(d.mapInArrow(
        _pieces(tokenizer or default_tokenizer(), capacity, separator),
        "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn(
        "n", F.monotonically_increasing_id()), "pack-pieces")  # repeated rows must not rank as one group
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = runs_of(solve(histogram, capacity))
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("n"), F.lit(BUCKETS)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = p.groupBy("length", "bucket").agg(F.count("*").alias("rows"))  # at most capacity * BUCKETS rows
    counts = counts.select("length", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("n")
    p = p.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"])
    return p.withColumn("rank", F.col("rank") + F.col("before")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                       "sequence_id long, offset long")


def op3(docs: DataFrame) -> DataFrame:
    """Contract of op3_packing."""
    return pack(docs)
