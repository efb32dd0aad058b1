"""Logistic regression by full-batch gradient descent.

An iteration is one aggregate over the (cached) features: the gradient sums come
back, the new weights go out as literals.  The constant is not penalised.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import argmax, sigmoid, softmax


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    classes: tuple
    weights: np.ndarray  # (features + 1) x (1 or classes), the constant first

    def _z(self, k: int) -> Column:
        w = self.weights[:, k]
        return sum((F.lit(float(v)) * F.col(c) for v, c in zip(w[1:], self.features, strict=True)), F.lit(float(w[0])))

    def probabilities(self) -> Column:
        """An array with the probability of each class."""
        if len(self.classes) == 2:
            p = sigmoid(self._z(0))
            return F.array(1.0 - p, p)
        return softmax(F.array(*[self._z(k) for k in range(len(self.classes))]))

    def predict(self, threshold: float = 0.5) -> Column:
        if len(self.classes) == 2:
            return F.when(sigmoid(self._z(0)) >= threshold, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))
        return F.array(*[F.lit(c) for c in self.classes])[argmax(self.probabilities())]


def _prepare(df: DataFrame, xs: Sequence[str], y: str) -> tuple[DataFrame, list]:
    data = df.select(*[F.col(c).cast("double").alias(c) for c in xs], F.col(y).alias("_y"))
    if data.filter(" or ".join(f"`{c}` is null or isnan(`{c}`)" for c in xs)).limit(1).count():
        raise ValueError("features hold nulls: impute them first")
    return data.cache(), sorted(r[0] for r in data.select("_y").distinct().collect())


def fit(df: DataFrame, xs: Sequence[str], y: str, rate: float = 0.01, rounds: int = 1000, penalty: float = 0.0,
        class_weight: str | Mapping | None = None) -> LogisticModel:
    """Two classes: one sigmoid; more: softmax (class weights count for two only)."""
    data, classes = _prepare(df, xs, y)
    columns = [F.lit(1.0), *[F.col(c) for c in xs]]
    try:
        counts = {r[0]: r[1] for r in data.groupBy("_y").count().collect()}
        n = sum(counts.values())
        many = len(classes) != 2
        weight: Column = F.lit(1.0)
        if class_weight is not None and not many:
            given = {c: n / (2 * counts[c]) for c in classes} if class_weight == "balanced" else class_weight
            weight = F.when(F.col("_y") == F.lit(classes[1]), float(given[classes[1]])).otherwise(float(given[classes[0]]))
        w = np.zeros((len(columns), len(classes) if many else 1))
        for _ in range(rounds):
            model = LogisticModel(tuple(xs), tuple(classes), w)
            scored = data.withColumn("_p", model.probabilities())
            sums = []
            for k in range(w.shape[1]):
                truth = F.col("_y") == F.lit(classes[k if many else 1])
                gap = (F.col("_p")[k if many else 1] - truth.cast("double")) * weight
                sums += [F.sum(gap * x).alias(f"g{j}_{k}") for j, x in enumerate(columns)]
            row = scored.agg(*sums).first()
            slope = np.array([[row[f"g{j}_{k}"] for k in range(w.shape[1])] for j in range(len(columns))]) / n
            slope[1:] += penalty / n * w[1:]
            w = w - rate * slope
        return LogisticModel(tuple(xs), tuple(classes), w)
    finally:
        data.unpersist()


def fit_legacy(df: DataFrame, xs: Sequence[str], y: str, rate: float = 0.01, rounds: int = 1000, penalty: float = 0.0, tolerance: float = 1e-4) -> LogisticModel:
    """The older form: penalty times w (not over n), and a stop on the L1 step."""
    data, classes = _prepare(df, xs, y)
    columns = [F.lit(1.0), *[F.col(c) for c in xs]]
    n, w = data.count(), np.zeros((len(columns), 1))
    try:
        for _ in range(rounds):
            model = LogisticModel(tuple(xs), tuple(classes), w)
            gap = model.probabilities()[1] - (F.col("_y") == F.lit(classes[1])).cast("double")
            row = data.agg(*[F.sum(gap * x).alias(f"g{j}") for j, x in enumerate(columns)]).first()
            slope = np.array([[row[f"g{j}"]] for j in range(len(columns))]) / n
            slope[1:] += penalty * w[1:]
            w = w - rate * slope
            if np.abs(rate * slope).sum() < tolerance:
                break
        return LogisticModel(tuple(xs), tuple(classes), w)
    finally:
        data.unpersist()
