"""Profiling: one pass over the data a report, whatever the column count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import quantiles_and

STATISTICS = ["count", "nulls", "distinct", "mean", "std", "min", "q25", "q50", "q75", "max"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def schema_info(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def _tall(row: DataFrame, cells: Sequence[tuple[Sequence, Sequence[str]]], names: str) -> DataFrame:
    """One wide row to a row for each of ``cells``: literals, then column names."""
    structs = [
        F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(keys)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
        for keys, cols in cells
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*").toDF(*names.split())


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, nulls, mean, sample std, min, exact quartiles and max a column."""
    aggregates: list[Column] = []
    for c in columns:
        x = F.col(c).cast("double")
        aggregates += [
            F.count(x).alias(f"{c}|count"), F.sum(x.isNull().cast("long")).alias(f"{c}|nulls"), F.avg(x).alias(f"{c}|mean"),
            F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max"),
        ]
    quartiles, found = quantiles_and(df, columns, (0.25, 0.5, 0.75), aggregates)
    row = df.sparkSession.createDataFrame([found], df.agg(*aggregates).schema).withColumns({
        f"{c}|{q}": F.lit(v).cast("double") for c in columns for q, v in zip(("q25", "q50", "q75"), quartiles[c], strict=True)})
    stats = [s for s in STATISTICS if s != "distinct"]
    return _tall(row, [((c,), [f"`{c}|{s}`" for s in stats]) for c in columns], "column_name n nulls mean std min q25 q50 q75 max")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return _tall(row, [((c,), [f"`{c}`"]) for c in columns], "column_name nulls")


def is_binary(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """Which columns hold nothing but 0 and 1 (nulls aside); one aggregate."""
    row = df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows a class, their share, and the ratio of the largest class to it."""
    counts = df.groupBy(label).count()
    whole = counts.agg(F.sum("count").alias("total"), F.max("count").alias("most"))
    return counts.crossJoin(F.broadcast(whole)).select(  # whole is one row
        F.col(label).alias("label"), F.col("count").alias("n"), (F.col("count") / F.col("total")).alias("share"),
        (F.col("most") / F.col("count")).alias("imbalance"))


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct rows, later repeats and the number of repeated groups."""
    groups = df.groupBy(*columns).count()
    return groups.agg(F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                      F.sum(F.col("count") - 1).alias("n_duplicates"), F.sum((F.col("count") > 1).cast("long")).alias("n_repeated"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of each pair (a before b), over rows where both are known."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"{a}|{b}") for a, b in pairs])
    return _tall(row, [((a, b), [f"`{a}|{b}`"]) for a, b in pairs], "a b r")


def strong_correlations(df: DataFrame, columns: Sequence[str], over: float = 0.75) -> DataFrame:
    return correlations(df, columns).filter((F.abs("r") > over) & (F.abs("r") < 1))


def top_correlated(df: DataFrame, columns: Sequence[str], target: str, k: int) -> DataFrame:
    """The k columns with the largest absolute correlation with the target."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return _tall(row, [((c,), [f"`{c}`"]) for c in columns], "column_name r").orderBy(F.desc(F.abs("r")), "column_name").limit(k)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from min to max; the last one is closed."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    spot = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))))
    return df.filter(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(spot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pivot(df: DataFrame, rows: str, columns: str, values: Sequence, measure: Column) -> DataFrame:
    return df.groupBy(rows).pivot(columns, list(values)).agg(measure)


def class_mean_vector(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each class: label, place, mean."""
    cells = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("place", "x"))
    return cells.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def conditional_means(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    """Means over rows with flag 1 and with flag 0, in one pass."""
    return df.agg(*[F.avg(F.when(F.col(flag) == v, F.col(c).cast("double"))).alias(f"{c}_{v}") for c in columns for v in (1, 0)])


def null_total(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
