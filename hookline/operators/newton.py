"""Logistic regression for all training folds at once, by Newton steps on Gram sums.

A fold's training set is every row of the other folds, so one pass over the rows
serves all models: each task adds its rows' loss, gradient and Hessian
(features x features) to the k - 1 models they train, and a grouped sum of these vectors is all that moves. The
driver solves k small systems an iteration. Objective of each model:

    C * sum(log-loss) + |w|^2 / 2     (intercept not penalised)

over features standardised with the mean and population standard deviation of
that model's own training rows. Those come from one pass too: moments per
fold, merged over the other folds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LR_C, LR_MAX_ITER
from .models import raw_vector, training_rows, write_meta

#: Newton stops when no step can lower the objective by more than this share of a row's loss.
DECREMENT = 1e-12
#: Partial sums of tasks are merged in this many groups first, so that no task adds up all of them.
MERGE_GROUPS = 16
#: The fold number that no row has: its "training fold" is the whole table.
ALL_ROWS = 0

Stats = dict[str, tuple[float, float]]


# ---- moments per fold, merged over the others -------------------------------------

@dataclass
class Moments:
    """Rows, mean and sum of squared distances from the mean, per feature."""
    n: int
    mean: np.ndarray
    m2: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.m2 + other.m2 + d * d * (self.n * other.n / n))

    def std(self) -> np.ndarray:
        return np.sqrt(self.m2 / max(self.n, 1))


def fold_moments(df: DataFrame, vector: str, fold: str, width: int) -> dict[int, Moments]:
    """Moments of every fold in one grouped summary (k rows reach the driver)."""
    s = df.groupBy(fold).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col(vector)).alias("s")) \
          .select(fold, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"),
                  vector_to_array("s.variance").alias("variance"))
    out = {}
    for r in s.collect():
        n = int(r["n"])   # the summary's variance divides by n - 1
        out[r[fold]] = Moments(n, np.array(r["mean"]), np.array(r["variance"]) * max(n - 1, 0))
    return out


def complement(moments: dict[int, Moments], fold: int, width: int) -> Moments:
    """All rows but those of ``fold``."""
    total = Moments(0, np.zeros(width), np.zeros(width))
    for f in sorted(moments):
        if f != fold:
            total = total + moments[f]
    return total


# ---- the agent -----------------------------------------------------------------------

@dataclass
class NewtonAgent:
    """A fitted linear scorer over named numeric columns; scoring is one column expression."""
    cols: list[str]
    scale: bool = True
    C: float = LR_C
    stats: Stats = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0
    iterations: int = 0

    def fit(self, df: DataFrame, label: str = "y") -> NewtonAgent:
        got = fit_folds(df.withColumn("_one", F.lit(1)), self.cols, "_one", [ALL_ROWS], label, self.scale, self.C)[ALL_ROWS]
        self.stats, self.weights, self.intercept, self.iterations = got.stats, got.weights, got.intercept, got.iterations
        return self

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for c, w in zip(self.cols, self.weights):
            mean, std = self.stats[c]
            z = z + (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) - mean) * (w / (std if std > 0 else 1.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.probability())

    def save(self, path: str) -> None:
        write_meta(path, {"cols": self.cols, "scale": self.scale, "C": self.C, "stats": self.stats,
                          "weights": self.weights, "intercept": self.intercept, "iterations": self.iterations})

    @classmethod
    def load(cls, spark, path: str) -> NewtonAgent:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        meta["stats"] = {k: tuple(v) for k, v in meta["stats"].items()}
        return cls(**meta)


# ---- the solver ------------------------------------------------------------------------

def _partial_sums(points: dict[int, np.ndarray], mean: dict[int, np.ndarray], std: dict[int, np.ndarray]):
    """(x, label, fold) -> one row a model and task: loss, gradient and Hessian of the log-loss at ``points``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(next(iter(points.values())))
        sums = {t: np.zeros(1 + width + width * width) for t in points}
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            rows += b.num_rows
            x = pc.list_flatten(b.column("x")).to_numpy(zero_copy_only=False).reshape(b.num_rows, width - 1)
            y, fold = b.column("label").to_numpy(), b.column("fold").to_numpy()
            for t, w in points.items():
                mine = fold != t
                a = np.ones((int(mine.sum()), width))
                a[:, :-1] = (x[mine] - mean[t]) / std[t]
                z = a @ w
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                s = sums[t]
                s[0] += (np.logaddexp(0, z) - y[mine] * z).sum()
                s[1:1 + width] += a.T @ (p - y[mine])
                s[1 + width:] += (a.T @ (a * (p * (1 - p))[:, None])).ravel()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))],
                                             ["model", "sums"])
    return run


def _evaluate(train: DataFrame, points, mean, std) -> dict[int, np.ndarray]:
    """One job: the summed partial sums of every model."""
    part = train.mapInArrow(_partial_sums(points, mean, std), "model int, sums array<double>") \
                .select("model", array_to_vector("sums").alias("v"),
                        F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g"))
    some = part.groupBy("model", "g").agg(Summarizer.sum(F.col("v")).alias("v"))
    whole = some.groupBy("model").agg(Summarizer.sum(F.col("v")).alias("v"))
    return {r["model"]: r["v"].toArray() for r in whole.collect()}


class _Newton:
    """One model's progress: the next point to evaluate, until no step helps."""

    def __init__(self, width: int, C: float, rows: int):
        self.C, self.floor = C, DECREMENT * max(rows, 1)
        self.at, self.done, self.steps = np.zeros(width), False, 0
        self.best: tuple[float, np.ndarray] | None = None
        self.direction, self.size, self.drop = np.zeros(width), 1.0, 0.0
        self.penalty = np.append(np.ones(width - 1), 0.0)

    def see(self, sums: np.ndarray) -> None:
        width = len(self.at)
        self.steps += 1
        loss = self.C * sums[0] + (self.penalty * self.at ** 2).sum() / 2
        if self.best is not None and loss > self.best[0] - 1e-4 * self.size * self.drop + self.floor:
            self.size /= 2
            if self.size < 1e-6:
                self.at, self.done = self.best[1], True
            else:
                self.at = self.best[1] - self.size * self.direction
            return
        self.best = (loss, self.at)
        gradient = self.C * sums[1:1 + width] + self.penalty * self.at
        hessian = self.C * sums[1 + width:].reshape(width, width) + np.diag(self.penalty)
        self.direction = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        self.size, self.drop = 1.0, float(gradient @ self.direction)
        if self.drop <= self.floor:
            # the last step is below the tolerance and may be taken without another look
            self.at, self.done = self.at - self.direction, True
        else:
            self.at = self.at - self.direction


def fit_folds(df: DataFrame, cols: list[str], fold: str, folds: list[int], label: str = "y", scale: bool = True,
              C: float = LR_C, max_iter: int = LR_MAX_ITER) -> dict[int, NewtonAgent]:
    """Per fold t of ``folds`` the agent trained on all rows whose ``fold`` is not t.

    Rows are written once; then one job for the moments and one an iteration for
    all models together. A training set of one class gives the constant score of that class,
    an empty one 0.5. Rows with a null label or fold train nothing.
    """
    train = df.select(raw_vector(cols).alias("v"), F.col(label).cast("double").alias("label"), F.col(fold).cast("int").alias("fold")) \
              .where("label IS NOT NULL AND fold IS NOT NULL")
    width = len(cols) + 1
    with training_rows(train.select(vector_to_array("v").alias("x"), "label", "fold")) as rows:
        moments = fold_moments(rows.select(array_to_vector(F.concat("x", F.array("label"))).alias("v"), "fold"), "v", "fold", width)
        whole = {t: complement(moments, t, width) for t in folds}
        mean = {t: m.mean[:-1] if scale else np.zeros(width - 1) for t, m in whole.items()}
        raw_std = {t: m.std()[:-1] if scale else np.ones(width - 1) for t, m in whole.items()}
        std = {t: np.where(s > 0, s, 1.0) for t, s in raw_std.items()}
        state = {t: _Newton(width, C, m.n) for t, m in whole.items()}
        for t, m in whole.items():
            share = m.mean[-1] if m.n else 0.5
            if not m.n or share in (0.0, 1.0):   # nothing to separate
                state[t].done, state[t].at[-1] = True, 0.0 if not m.n else np.copysign(700.0, share - 0.5)
        for _ in range(max_iter):
            open_ = {t: s.at for t, s in state.items() if not s.done}
            if not open_:
                break
            for t, sums in _evaluate(rows, open_, mean, std).items():
                state[t].see(sums)
    return {t: NewtonAgent(cols, scale, C, {c: (float(mean[t][i]), float(raw_std[t][i])) for i, c in enumerate(cols)},
                           [float(v) for v in s.at[:-1]], float(s.at[-1]), s.steps) for t, s in state.items()}
