"""Sufficient statistics: Gram matrices from one pass over the data.

Everything linear here (least squares, gradient descent, ridge and lasso paths,
cross-validation, covariance, discriminants) is a function of these sums, so the
data are read once however many models are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 20


@dataclass(frozen=True)
class Gram:
    """n, X'X, X'y and y'y; the first column of X is 1."""

    n: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.n - other.n, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def mse(self, w: np.ndarray) -> float:
        """Mean squared error of y ~ Xw on the rows summed here."""
        return float((self.yy - 2 * w @ self.xy + w @ self.xx @ w) / self.n)

    def r2(self, w: np.ndarray) -> float:
        spread = self.yy / self.n - (self.xy[0] / self.n) ** 2
        return 1 - self.mse(w) / spread if spread else float("nan")

    def pick(self, columns: Sequence[int]) -> Gram:
        """The statistics of a subset of the columns (0 is the constant)."""
        return Gram(self.n, self.xx[np.ix_(columns, columns)], self.xy[list(columns)], self.yy)

    def standardised(self) -> tuple[Gram, np.ndarray, np.ndarray]:
        """The statistics after z-scoring each column but the constant, with means and sample stds."""
        mean = self.xx[0] / self.n
        var = (np.diag(self.xx) - self.n * mean**2) / max(self.n - 1, 1)
        std = np.sqrt(np.maximum(var, 0))
        std[0], mean[0] = 1.0, 0.0
        std = np.where(std == 0, 1.0, std)
        t = np.diag(1 / std)
        t[0] = -mean / std
        t[0, 0] = 1.0
        return Gram(self.n, t.T @ self.xx @ t, t.T @ self.xy, self.yy), mean, std


def _sums(df: DataFrame, terms: dict[tuple[int, int], tuple], group: str | None) -> list:
    aggregates = [F.sum(a * b).alias(f"s{i}_{j}") for (i, j), (a, b) in terms.items()]
    rows = df.groupBy(F.col(group).alias("_g")).agg(*aggregates) if group else df.agg(*aggregates).withColumn("_g", F.lit(0))
    return rows.collect()


def gram(df: DataFrame, xs: Sequence[str], y: str | None = None, group: str | None = None) -> Gram | dict:
    """The statistics of all rows, or of each group (a few: folds or classes).

    Up to 20 columns are summed by expressions; more by one partial matrix a
    task and a sum of the partials.
    """
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double") if y else F.lit(0.0)]
    d = len(columns)
    if d - 1 <= FEW:
        terms = {(i, j): (columns[i], columns[j]) for i in range(d) for j in range(i, d)}
        found = {}
        for row in _sums(df, terms, group):
            m = np.zeros((d, d))
            for i, j in terms:
                m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
            found[row["_g"]] = m
    else:
        found = _partial(df, columns, F.col(group) if group else F.lit(0))
    grams = {g: Gram(float(m[0, 0]), m[:-1, :-1], m[:-1, -1], float(m[-1, -1])) for g, m in found.items()}
    return grams if group else grams.get(0, Gram(0.0, np.zeros((d - 1, d - 1)), np.zeros(d - 1), 0.0))


def _partial(df: DataFrame, columns: list, group) -> dict:
    d = len(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for g, part in frame.groupby("g"):
                x = np.stack(part["x"].to_numpy())
                sums[g] = sums.get(g, 0) + x.T @ x
        yield pd.DataFrame([(g, k, v) for g, m in sums.items() for k, v in enumerate(m.ravel())], columns=["g", "k", "v"])

    parts = df.select(group.cast("long").alias("g"), F.array(*columns).alias("x")).mapInPandas(run, "g bigint, k int, v double")
    found: dict = {}
    for row in parts.groupBy("g", "k").agg(F.sum("v").alias("v")).collect():
        found.setdefault(row["g"], np.zeros((d, d))).flat[row["k"]] = row["v"]
    return found


def covariance(g: Gram) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance) of the columns but the constant."""
    mean = g.xx[0, 1:] / g.n
    return mean, (g.xx[1:, 1:] - g.n * np.outer(mean, mean)) / max(g.n - 1, 1)


def vector_gram(df: DataFrame, vector: str, group: str | None = None) -> Gram | dict:
    """The same for an array column: one partial matrix a task."""
    size = df.select(F.size(vector)).first()[0]
    columns = [f"_x{i}" for i in range(size)]
    wide = df.select(*([F.col(group)] if group else []), *[F.col(vector)[i].cast("double").alias(c) for i, c in enumerate(columns)])
    return gram(wide, columns, None, group)


def shifted(df: DataFrame, xs: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """``df`` with each column less its mean, and the means.

    Sums of squares of such columns do not cancel, however large the means are.
    """
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(xs)]).first()
    means = np.array([row[f"m{i}"] or 0.0 for i in range(len(xs))])
    return df.withColumns({c: F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(xs, means, strict=True)}), means


def moments_of(df: DataFrame, xs: Sequence[str] | None = None, vector: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance) of columns or of an array column; two passes."""
    if vector is not None:
        size = df.select(F.size(vector)).first()[0]
        xs = [f"_x{i}" for i in range(size)]
        df = df.select(*[F.col(vector)[i].cast("double").alias(c) for i, c in enumerate(xs)])
    centred, means = shifted(df, xs)
    g = gram(centred, xs)
    rest, cov = covariance(g)
    return g.n, means + rest, cov
