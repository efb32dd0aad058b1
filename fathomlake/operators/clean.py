"""Cleaning: dirt becomes null, rows with too many nulls go."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import quantiles
from .profile import is_binary, null_total

SQFT_TO_M2 = 0.092903


def convert_units(df: DataFrame, area: str, units: str, small: str = "m2", large: str = "sqft",
                  factor: float = SQFT_TO_M2, out: str = "area_m2") -> DataFrame:
    """``out`` = the area in the small unit, and the unit as a 1/0 flag.

    An unknown unit gives a null flag and is converted like the large unit.
    """
    flag = F.when(F.col(units) == large, 1).when(F.col(units) == small, 0)
    metric = F.when(flag == 0, F.col(area)).otherwise(F.col(area) * factor)
    return df.withColumn(out, metric).withColumn(units, flag)


def limits_to_null(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside the closed range become null."""
    for c, (low, high) in limits.items():
        x, ok = F.col(c), F.lit(True)
        ok = ok if low is None else ok & (x >= low)
        ok = ok if high is None else ok & (x <= high)
        df = df.withColumn(c, F.when(ok, x))
    return df


def negatives_to_null(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Negative numbers become null, but in ``keep`` and in 0/1 columns."""
    open_to = [c for c in columns if c not in keep]
    binary = is_binary(df, open_to) if open_to else {}
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in open_to if not binary[c]})


def quantile_fences(df: DataFrame, columns: Sequence[str], low: float, high: float, width: float) -> dict[str, tuple[float, float]]:
    """The fences of all columns, from exact quantiles found in common passes."""
    ends = {c: q for c, q in quantiles(df, columns, (low, high)).items() if q[0] is not None}
    return {c: (a - width * (b - a), b + width * (b - a)) for c, (a, b) in ends.items()}


def outliers_to_null(df: DataFrame, columns: Sequence[str], low: float = 0.15, high: float = 0.85, width: float = 1.5) -> DataFrame:
    """Values beyond ``width`` spreads from the quantiles become null (not 0/1 columns)."""
    binary = is_binary(df, columns)
    fences = quantile_fences(df, [c for c in columns if not binary[c]], low, high, width)
    return df.withColumns({c: F.when(F.col(c).between(a, b), F.col(c)) for c, (a, b) in fences.items()})


def outlier_mask(df: DataFrame, columns: Sequence[str], low: float = 0.25, high: float = 0.75, width: float = 1.5) -> DataFrame:
    """``<c>_outlier``: is the value beyond the fences; null is not."""
    fences = quantile_fences(df, columns, low, high, width)
    return df.withColumns({f"{c}_outlier": F.coalesce(~F.col(c).between(a, b), F.lit(False)) for c, (a, b) in fences.items()})


def drop_high_null_rows(df: DataFrame, columns: Sequence[str], threshold: int) -> DataFrame:
    """Rows with ``threshold`` nulls or more go."""
    return df.filter(null_total(columns) < threshold)


def clean(df: DataFrame, limits: Mapping[str, tuple], columns: Sequence[str], keep_negative: Sequence[str] = (),
          null_threshold: int = 7) -> DataFrame:
    """Limits, negatives, outliers, then rows: in that order."""
    out = negatives_to_null(limits_to_null(df, limits), columns, keep_negative)
    return drop_high_null_rows(outliers_to_null(out, columns), columns, null_threshold)


def cluster_outliers_to_null(df: DataFrame, column: str, row_id: str, rounds: int = 10) -> DataFrame:
    """Fences (quartiles, 1.5 spreads) inside each of two clusters of a column.

    The clusters are those of 2-means started at the smallest and the largest
    value; a cluster of two values or fewer is left alone.
    """
    ends = df.agg(F.min(column), F.max(column)).first()
    a, b = float(ends[0]), float(ends[1])
    for _ in range(rounds):
        near = F.abs(F.col(column) - a) <= F.abs(F.col(column) - b)
        m = df.agg(F.avg(F.when(near, F.col(column))), F.avg(F.when(~near, F.col(column)))).first()
        new = (a if m[0] is None else m[0], b if m[1] is None else m[1])
        if new == (a, b):
            break
        a, b = new
    side = F.when(F.abs(F.col(column) - a) <= F.abs(F.col(column) - b), 0).otherwise(1)
    split = df.withColumn("_side", side)
    fences = split.groupBy("_side").agg(F.count(column).alias("_n"), F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    spread = F.col("_q")[1] - F.col("_q")[0]
    ok = (F.col("_n") <= 2) | F.col(column).between(F.col("_q")[0] - 1.5 * spread, F.col("_q")[1] + 1.5 * spread)
    return split.join(F.broadcast(fences), "_side").withColumn(column, F.when(ok, F.col(column))).drop("_side", "_n", "_q")
