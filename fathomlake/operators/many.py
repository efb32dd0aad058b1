"""Many logistic models in one pass over the rows.

Models differ in their rows, rate and penalty.  A row carries an array with its
weight in every set of rows (a split, a fold, a rebalancing; 0: not in it), so it
is stored once for all of them.  A round of gradient descent is one job: every
task multiplies its rows with the table of all models' weights and returns a sum
for each model and term.  With ``scale`` each model standardises its features by
the moments of its own set; the moments of all sets are one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logistic import LogisticModel
from .metrics import labels_of


@dataclass(frozen=True)
class Config:
    """One model to fit: the place of its set of rows, and how it is fitted."""

    rows: int
    rate: float = 0.01
    penalty: float = 0.0


@dataclass(frozen=True)
class Models:
    features: tuple[str, ...]
    classes: tuple
    configs: tuple[Config, ...]
    weights: np.ndarray  # (features + 1) x models, the constant first, for the features as given

    def one(self, place: int) -> LogisticModel:
        return LogisticModel(self.features, self.classes, self.weights[:, [place]])


def _rows(df: DataFrame, xs: Sequence[str], y: str, sets: Column, classes: Sequence) -> DataFrame:
    x = F.array(*[F.col(c).cast("double") for c in xs])
    return df.select(x.alias("x"), (F.col(y) == F.lit(classes[1])).cast("double").alias("t"), F.transform(sets, lambda s: s.cast("double")).alias("s"))


def _chances(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x, s = (batch.column(i).flatten().to_numpy().reshape(n, -1) for i in (0, 2))
    z = np.clip(x @ weights[1:] + weights[0], -500, 500)
    return x, batch.column(1).to_numpy(), s, 1 / (1 + np.exp(-z))


def _gradients(data: DataFrame, configs: Sequence[Config], weights: np.ndarray) -> np.ndarray:
    """Sums of the gaps times each term: (features + 1) x models."""
    sent, of = data.sparkSession.sparkContext.broadcast(weights), [c.rows for c in configs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.shape)
        for batch in batches:
            if batch.num_rows:
                x, t, s, p = _chances(batch, sent.value)
                gap = (p - t[:, None]) * s[:, of]
                total[0] += gap.sum(axis=0)
                total[1:] += x.T @ gap
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(weights.size)
    for at, v in data.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    sent.unpersist()
    return out.reshape(weights.shape)


def fit(df: DataFrame, xs: Sequence[str], y: str, sets: Column, configs: Sequence[Config], rounds: int = 1000, scale: bool = False) -> Models:
    """All models, by full-batch gradient descent from zero; two classes."""
    classes = labels_of(df, y, y)
    if len(classes) != 2:
        raise ValueError(f"two classes are needed, not {len(classes)}")
    data = _rows(df, xs, y, sets, classes)
    if data.filter(F.exists("x", lambda v: v.isNull() | F.isnan(v))).limit(1).count():
        raise ValueError("features hold nulls: impute them first")
    data = data.cache()
    try:
        some, d = sorted({c.rows for c in configs}), len(xs)
        inside = {i: F.col("s")[i] > 0 for i in some}
        row = data.agg(*[F.sum(inside[i].cast("long")).alias(f"n{i}") for i in some],
                       *[f(F.when(inside[i], F.col("x")[j])).alias(f"{k}{i}_{j}") for i in some for j in range(d) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        n = np.array([row[f"n{c.rows}"] for c in configs], float)
        if not (n > 0).all():
            raise ValueError("a set has no rows")
        mean, share = np.zeros((d, len(configs))), np.ones((d, len(configs)))
        if scale:
            mean = np.array([[row[f"m{c.rows}_{j}"] for c in configs] for j in range(d)], float)
            std = np.array([[row[f"s{c.rows}_{j}"] or 0.0 for c in configs] for j in range(d)], float)
            share = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        rate, penalty = (np.array([getattr(c, k) for c in configs], float) for k in ("rate", "penalty"))
        w = np.zeros((d + 1, len(configs)))  # of the scaled features

        def plain() -> np.ndarray:
            return np.vstack([w[:1] - (w[1:] * mean * share).sum(axis=0), w[1:] * share])

        for _ in range(rounds):
            g = _gradients(data, configs, plain())
            slope = np.vstack([g[:1], (g[1:] - mean * g[:1]) * share]) / n
            slope[1:] += penalty / n * w[1:]
            w = w - rate * slope
        return Models(tuple(xs), tuple(classes), tuple(configs), plain())
    finally:
        data.unpersist()


def confusions(df: DataFrame, models: Models, y: str, held: Column) -> np.ndarray:
    """models x 2 x 2: rows by truth and prediction; ``held`` has for each set whether the row is scored."""
    sent, of = df.sparkSession.sparkContext.broadcast(models.weights), [c.rows for c in models.configs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(of), 2, 2), np.int64)
        for batch in batches:
            if batch.num_rows:
                _, t, s, p = _chances(batch, sent.value)
                for truth in (0, 1):
                    for guess in (0, 1):
                        hit = (s[:, of] > 0) & (t == truth)[:, None] & ((p >= 0.5) == bool(guess))
                        total[:, truth, guess] += hit.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "n"])

    out = np.zeros(len(of) * 4, np.int64)
    found = _rows(df, models.features, y, held, models.classes).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n"))
    for at, v in found.collect():
        out[at] = v
    return out.reshape(-1, 2, 2)


def scores(counts: np.ndarray, metric: str = "f1") -> np.ndarray:
    """accuracy, or precision, recall or f1 of the second class, of each model; 0 where undefined."""
    tn, fp, fn, tp = (counts[:, i, j].astype(float) for i in (0, 1) for j in (0, 1))
    above, below = {"accuracy": (tp + tn, tp + tn + fp + fn), "precision": (tp, tp + fp), "recall": (tp, tp + fn), "f1": (2 * tp, 2 * tp + fp + fn)}[metric]
    return np.divide(above, below, out=np.zeros_like(above), where=below > 0)
