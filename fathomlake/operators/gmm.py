"""Gaussian mixtures by expectation-maximisation from weighted sums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import argmax
from .gram import moments_of
from .kmeans import KMeansModel

FLOOR = 1e-300


@dataclass(frozen=True)
class GmmModel:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def densities(self, columns: Sequence[str]) -> list[Column]:
        d, out = len(columns), []
        for w, m, c in zip(self.weights, self.means, self.covariances, strict=True):
            inverse = np.linalg.inv(c)
            scale = float(w / np.sqrt((2 * np.pi) ** d * np.linalg.det(c)))
            gap = [F.col(x) - F.lit(float(v)) for x, v in zip(columns, m, strict=True)]
            form = sum((gap[i] * gap[j] * float(inverse[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
            out.append(F.lit(scale) * F.exp(-0.5 * form))
        return out

    def responsibilities(self, columns: Sequence[str]) -> Column:
        """Posterior of each component; a vanishing density is floored."""
        parts = [F.greatest(p, F.lit(FLOOR)) for p in self.densities(columns)]
        total = sum(parts[1:], parts[0])
        return F.array(*[p / total for p in parts])

    def predict(self, columns: Sequence[str]) -> Column:
        return argmax(self.responsibilities(columns))

    def log_likelihood(self, df: DataFrame, columns: Sequence[str]) -> float:
        parts = [F.greatest(p, F.lit(FLOOR)) for p in self.densities(columns)]
        return df.agg(F.sum(F.log(sum(parts[1:], parts[0])))).first()[0] or 0.0


def initial(df: DataFrame, columns: Sequence[str], centres: np.ndarray) -> GmmModel:
    """Even weights, the centres, and the whole covariance plus 1e-6 for each."""
    _, _, cov = moments_of(df, columns)
    k = len(centres)
    return GmmModel(np.full(k, 1 / k), np.array(centres, float), np.array([cov + 1e-6 * np.eye(len(columns))] * k))


def fit(df: DataFrame, columns: Sequence[str], centres: np.ndarray | KMeansModel, max_rounds: int = 100, tolerance: float = 1e-3, ridge: float = 1e-9) -> GmmModel:
    """Rounds until the log likelihood after the M step changes by less than the tolerance."""
    points = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).cache()
    d, last = len(columns), None
    model = initial(points, columns, centres.centres if isinstance(centres, KMeansModel) else centres)
    try:
        for _ in range(max_rounds):
            scored = points.withColumn("_r", model.responsibilities(columns))
            sums = []
            for k in range(len(model.weights)):
                r = F.col("_r")[k]
                sums.append(F.sum(r).alias(f"n_{k}"))
                for i in range(d):
                    sums.append(F.sum(r * F.col(columns[i])).alias(f"m_{k}_{i}"))
                    # centred at the old mean, to keep digits
                    sums += [F.sum(r * (F.col(columns[i]) - float(model.means[k, i])) * (F.col(columns[j]) - float(model.means[k, j]))).alias(f"c_{k}_{i}_{j}") for j in range(i, d)]
            row = scored.agg(F.count(F.lit(1)).alias("n"), *sums).first()
            weights, means, covs = [], [], []
            for k in range(len(model.weights)):
                n_k = row[f"n_{k}"]
                mean = np.array([row[f"m_{k}_{i}"] / n_k for i in range(d)])
                moved = mean - model.means[k]
                cov = np.array([[row[f"c_{k}_{min(i, j)}_{max(i, j)}"] / n_k for j in range(d)] for i in range(d)]) - np.outer(moved, moved)
                weights.append(n_k / row["n"])
                means.append(mean)
                covs.append(cov + ridge * np.eye(d))
            model = GmmModel(np.array(weights), np.array(means), np.array(covs))
            now = model.log_likelihood(points, columns)
            if last is not None and abs(now - last) < tolerance:
                break
            last = now
        return model
    finally:
        points.unpersist()
