"""Linear discriminant analysis: class means and a pooled covariance in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import argmax, lit_vector
from .gram import gram, shifted


@dataclass(frozen=True)
class LdaModel:
    features: tuple[str, ...]
    classes: tuple
    priors: np.ndarray
    means: np.ndarray
    covariance: np.ndarray
    inverse: np.ndarray
    log_determinant: float

    def probabilities(self) -> Column:
        """Posteriors; where the evidence vanishes all classes weigh alike."""
        d, joint = len(self.features), []
        scale = np.exp(-0.5 * (d * np.log(2 * np.pi) + self.log_determinant))
        for prior, mean in zip(self.priors, self.means, strict=True):
            gap = [F.col(c) - F.lit(float(m)) for c, m in zip(self.features, mean, strict=True)]
            form = sum((gap[i] * gap[j] * float(self.inverse[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
            joint.append(F.lit(float(prior * scale)) * F.exp(-0.5 * form))
        total = sum(joint, F.lit(0.0))
        even = lit_vector([1 / len(self.classes)] * len(self.classes))
        return F.when(total <= 1e-15, even).otherwise(F.array(*[j / total for j in joint]))

    def predict(self) -> Column:
        return F.array(*[F.lit(c) for c in self.classes])[argmax(self.probabilities())]


def fit(df: DataFrame, xs: Sequence[str], y: str) -> LdaModel:
    """Covariance over n - K (over n if n <= K); pseudo-inverse if near singular."""
    centred, shift = shifted(df.filter(F.col(y).isNotNull()), xs)
    groups = gram(centred, xs, None, y)
    classes = sorted(groups)
    n, k = sum(g.n for g in groups.values()), len(classes)
    means = np.array([groups[c].xx[0, 1:] / groups[c].n for c in classes])
    scatter = sum(groups[c].xx[1:, 1:] - groups[c].n * np.outer(m, m) for c, m in zip(classes, means, strict=True))
    cov = scatter / (n - k if n > k else n)
    singular = np.linalg.svd(cov, compute_uv=False)
    kept = singular[singular > 1e-12 * singular.max()] if singular.max() > 0 else np.ones(1)
    inverse = np.linalg.inv(cov) if len(kept) == len(xs) else np.linalg.pinv(cov)
    return LdaModel(tuple(xs), tuple(classes), np.array([groups[c].n / n for c in classes]), means + shift, cov, inverse, float(np.log(kept).sum()))
