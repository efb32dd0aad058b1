"""Linear regression from sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .gram import Gram, gram


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]  # the constant first

    def predict(self) -> Column:
        return sum((F.lit(w) * F.col(c) for w, c in zip(self.weights[1:], self.features, strict=True)), F.lit(self.weights[0]))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        names = ["intercept", *self.features]
        return spark.createDataFrame(list(zip(names, map(float, self.weights), strict=True)), "term string, weight double")


def least_squares(g: Gram) -> np.ndarray:
    """The pseudo-inverse solution: of minimum norm if the rank is deficient."""
    return np.linalg.pinv(g.xx, hermitian=True) @ g.xy


def gradient_descent(g: Gram, rate: float = 1e-4, rounds: int = 10_000, tolerance: float = 1e-6, l1: float = 0.0, l2: float = 0.0) -> np.ndarray:
    """From zero, with the constant penalised too; ends when the error settles.

    The step is ``-2/n X'(y - Xw) + l1 sign(w) + l2 w``; the last step taken
    before the error changes by less than the tolerance is kept.
    """
    w, last = np.zeros(len(g.xy)), np.inf
    for _ in range(rounds):
        slope = -2 / g.n * (g.xy - g.xx @ w)
        w = w - rate * (slope + l1 * np.sign(w) + l2 * w)
        error = g.mse(w)
        if abs(last - error) < tolerance:
            break
        last = error
    return w


def fit_ols(df: DataFrame, xs: Sequence[str], y: str) -> LinearModel:
    return LinearModel(tuple(xs), tuple(map(float, least_squares(gram(df, xs, y)))))


def fit_gd(df: DataFrame, xs: Sequence[str], y: str, **options) -> LinearModel:
    return LinearModel(tuple(xs), tuple(map(float, gradient_descent(gram(df, xs, y), **options))))


def fit_basis(df: DataFrame, functions: Sequence[Column], y: str) -> np.ndarray:
    """Least squares on basis functions (column expressions), constant first."""
    named = df.select(*[f.alias(f"_b{i}") for i, f in enumerate(functions)], F.col(y))
    return least_squares(gram(named, [f"_b{i}" for i in range(len(functions))], y))


def penalty_path(g: Gram, penalties: Sequence[float], kind: str, **options) -> dict[float, np.ndarray]:
    """Weights for each penalty, all from one Gram matrix."""
    return {p: gradient_descent(g, **{"l2" if kind == "ridge" else "l1": p}, **options) for p in penalties}


def holdout_penalty(train: Gram, validation: Gram, penalties: Sequence[float], kind: str = "ridge", **options) -> list[tuple[float, float]]:
    """(penalty, validation error); the first smallest wins."""
    options = {"rate": 1e-5} | options
    return [(p, validation.mse(w)) for p, w in penalty_path(train, penalties, kind, **options).items()]


def cross_validated_penalty(folds: dict[int, Gram], penalties: Sequence[float], kind: str = "ridge", leaky: bool = False, **options) -> list[tuple[float, float]]:
    """(penalty, mean error over the folds); fold -1 is in every train part.

    Each train part is the total less the fold: no row is read again.  The
    columns are z-scored with the train part's statistics, or with ``leaky``
    with those of all rows.
    """
    options = {"rate": 1e-3} | options
    total = sum((g for g in list(folds.values())[1:]), list(folds.values())[0])
    errors: dict[float, list[float]] = {p: [] for p in penalties}
    for i, fold in folds.items():
        if i < 0:
            continue
        train = total - fold
        base = total if leaky else train
        t = _scaling(base)
        for p, w in penalty_path(_apply(train, t), penalties, kind, **options).items():
            errors[p].append(_apply(fold, t).mse(w))
    return [(p, float(np.mean(e))) for p, e in errors.items()]


def _scaling(g: Gram) -> np.ndarray:
    _, mean, std = g.standardised()
    t = np.diag(1 / std)
    t[0] = -mean / std
    t[0, 0] = 1.0
    return t


def _apply(g: Gram, t: np.ndarray) -> Gram:
    return Gram(g.n, t.T @ g.xx @ t, t.T @ g.xy, g.yy)


def best(scores: Sequence[tuple[float, float]]) -> float:
    return min(scores, key=lambda s: s[1])[0]
