"""Principal components from the covariance matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import dot, lit_vector
from .gram import moments_of


@dataclass(frozen=True)
class PcaModel:
    mean: np.ndarray
    values: np.ndarray  # eigenvalues, largest first
    vectors: np.ndarray  # columns; the largest entry of each is positive
    n: float

    def project(self, vector: str, k: int, centred: bool = True) -> Column:
        """The first k coordinates; uncentred only for the older variant."""
        base = vector
        if centred:
            base = F.zip_with(vector, lit_vector(self.mean), lambda x, m: x.cast("double") - m)
        return F.array(*[dot(base, lit_vector(self.vectors[:, j])) for j in range(k)])

    def reconstruct(self, projected: str, k: int) -> Column:
        return F.array(*[dot(projected, lit_vector(self.vectors[i, :k])) + float(self.mean[i]) for i in range(len(self.mean))])

    def variance_ratio(self) -> np.ndarray:
        return self.values / self.values.sum()

    def components_for(self, share: float) -> int:
        """The fewest components whose variance reaches the share."""
        return int(np.argmax(np.cumsum(self.variance_ratio()) >= share - 1e-12)) + 1

    def reconstruction_error(self, k: int) -> float:
        """Mean squared error a cell: the trailing eigenvalues, no second pass."""
        return float(self.values[k:].sum() * (self.n - 1) / (self.n * len(self.values)))


def from_moments(n: float, mean: np.ndarray, cov: np.ndarray) -> PcaModel:
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])
    return PcaModel(mean, np.maximum(values, 0), vectors, n)


def fit(df: DataFrame, vector: str) -> PcaModel:
    return from_moments(*moments_of(df, vector=vector))
