"""Imputation.  Statistics come from a reference frame, by default the frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import nearest_rows


def mean_impute(df: DataFrame, columns: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """Nulls to the column's mean; a column with no value gets 0."""
    row = (reference or df).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(row[c]), F.lit(0.0)) for c in columns})


def _group_fill(df: DataFrame, column: str, group: str, statistic) -> DataFrame:
    values = df.groupBy(F.col(group).alias("_g")).agg(statistic.alias("_fill"))
    filled = F.coalesce(F.col(column).cast("double"), F.col("_fill"))
    return df.join(values, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(column, filled).drop("_g", "_fill")


def group_mean_impute(df: DataFrame, column: str, group: str) -> DataFrame:
    return _group_fill(df, column, group, F.avg(F.col(column).cast("double")))


def group_median_impute(df: DataFrame, column: str, group: str) -> DataFrame:
    return _group_fill(df, column, group, F.median(F.col(column).cast("double")))


def strategy_impute(df: DataFrame, strategies: Mapping[str, str | tuple[str, float]], reference: DataFrame | None = None) -> DataFrame:
    """mean, median, mode (smallest of equals), zero, (constant, value), remove_row."""
    reference = reference or df
    needed = {c: s for c, s in strategies.items() if s in ("mean", "median", "mode")}
    how = {"mean": lambda c: F.avg(c), "median": lambda c: F.median(c), "mode": lambda c: F.mode(c, True)}
    row = reference.agg(*[how[s](F.col(c)).alias(c) for c, s in needed.items()]).first() if needed else {}
    for c, s in strategies.items():
        if s == "remove_row":
            df = df.filter(F.col(c).isNotNull())
        elif s == "zero":
            df = df.withColumn(c, F.coalesce(c, F.lit(0)))
        elif isinstance(s, tuple):
            df = df.withColumn(c, F.coalesce(c, F.lit(s[1])))
        else:
            df = df.withColumn(c, F.coalesce(c, F.lit(row[c])))
    return df


def knn_mode_impute(df: DataFrame, target: str, features: Sequence[str], row_id: str, k: int = 5) -> DataFrame:
    """Nulls of the target to the mode of the k nearest rows' known values.

    The row itself and rows without a target count among the k nearest; ties in
    distance go to the smaller id, ties of the mode to the smaller value.  If
    none of the k has a value the null stays.
    """
    asked = df.filter(F.col(target).isNull())
    near = nearest_rows(df, asked, row_id, features, k, skip_self=False)
    values = df.filter(F.col(target).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(target).alias("_value"))
    fill = near.join(values, "id").groupBy("query_id").agg(F.mode("_value", True).alias("_fill"))
    return df.join(fill, F.col(row_id).cast("long") == F.col("query_id"), "left").withColumn(target, F.coalesce(target, "_fill")).drop("query_id", "_fill")


def knn_mean_impute(df: DataFrame, target: str, features: Sequence[str], row_id: str, k: int = 5) -> DataFrame:
    """Nulls to the mean of the k nearest complete rows, else the column mean, else 0."""
    asked, known = df.filter(F.col(target).isNull()), df.filter(F.col(target).isNotNull())
    near = nearest_rows(known, asked, row_id, features, k)
    values = known.select(F.col(row_id).cast("long").alias("id"), F.col(target).cast("double").alias("_value"))
    fill = near.join(values, "id").groupBy("query_id").agg(F.avg("_value").alias("_fill"))
    mean = known.agg(F.avg(F.col(target).cast("double"))).first()[0]
    out = F.coalesce(F.col(target).cast("double"), F.col("_fill"), F.lit(mean), F.lit(0.0))
    return df.join(fill, F.col(row_id).cast("long") == F.col("query_id"), "left").withColumn(target, out).drop("query_id", "_fill")


def impute_in_order(df: DataFrame, knn_target: str, knn_feature: str, mean_target: str, mean_group: str, row_id: str, k: int = 5,
                    others: Sequence[str] = ()) -> DataFrame:
    """One column by its nearest rows, another by its group's mean, then each of
    ``others`` that still has nulls by its nearest rows over all the rest."""
    df = group_mean_impute(knn_mode_impute(df, knn_target, [knn_feature], row_id, k), mean_target, mean_group)
    numeric = [c for c in (knn_target, knn_feature, mean_target, *others)]
    for c in others:
        df = knn_mode_impute(df, c, [f for f in dict.fromkeys(numeric) if f != c], row_id, k)
    return df
