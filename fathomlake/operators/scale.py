"""Scaling with statistics from one aggregate, applied as literals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import quantiles_and


@dataclass(frozen=True)
class Moments:
    means: dict[str, float | None]
    stds: dict[str, float | None]


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Means and sample standard deviations (nulls skipped)."""
    aggregates = [f(F.col(c).cast("double")).alias(f"{k}|{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggregates).first()
    return Moments({c: row[f"m|{c}"] for c in columns}, {c: row[f"s|{c}"] for c in columns})


def zscore(df: DataFrame, columns: Sequence[str], stats: Moments | None = None, epsilon: float = 0.0) -> DataFrame:
    """(x - mean) / (std + epsilon); without epsilon a constant column gives null."""
    stats = stats or moments(df, columns)
    return df.withColumns({
        c: F.try_divide(F.col(c) - F.lit(stats.means[c]), F.lit(stats.stds[c]) + F.lit(float(epsilon))) for c in columns
    })


def minmax(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """To [low, high]; constant columns are left as they are."""
    row = df.agg(*[f(c).alias(f"{k}|{c}") for c in columns for k, f in (("a", F.min), ("b", F.max))]).first()
    out = {}
    for c in columns:
        a, b = row[f"a|{c}"], row[f"b|{c}"]
        if a is not None and a != b:
            out[c] = (F.col(c) - F.lit(a)) / F.lit(b - a) * (high - low) + low
    return df.withColumns(out)


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores; constant columns are left as they are."""
    stats = moments(df, columns)
    return zscore(df, [c for c in columns if stats.stds[c]], stats)


def log_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Natural logarithm; null where it is not defined."""
    return df.withColumns({c: F.when(F.col(c) > 0, F.log(c)) for c in columns})


def median_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / std; no task holds a column's values."""
    medians, stds = quantiles_and(df, columns, [0.5], [F.stddev_samp(F.col(c).cast("double")) for c in columns])
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(math.nan if s is not None and math.isnan(s) else medians[c][0]), F.lit(s)) for c, s in zip(columns, stds, strict=True)})


def unscaled_coefficients(coefficients: dict[str, float], stats: Moments) -> dict[str, float]:
    """Coefficients of z-scored columns in terms of the columns themselves."""
    return {c: w / stats.stds[c] for c, w in coefficients.items() if stats.stds.get(c)}


def fold_preprocess(train: DataFrame, columns: Sequence[str], validation: DataFrame | None = None):
    """Scale, then fill nulls with the scaled train means (about 0).

    Both frames use the train statistics; without validation one frame returns.
    """
    from .impute import mean_impute

    stats = moments(train, columns)
    scaled = zscore(train, columns, stats, 1e-8)
    filled = mean_impute(scaled, columns)
    if validation is None:
        return filled
    return filled, mean_impute(zscore(validation, columns, stats, 1e-8), columns, scaled)
