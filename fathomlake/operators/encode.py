"""Encodings of categories.

Where an encoding needs the levels, they are aggregated first and joined back:
the levels' table has a row a level and no window runs over all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import key_rank


def flag_levels(df: DataFrame, column: str, levels: Sequence[str], prefix: str) -> DataFrame:
    """A 0/1 column for each named level; null stays null, others are 0."""
    c = F.col(column)
    return df.withColumns({f"{prefix}{v}": F.when(c.isNotNull(), (c == v).cast("int")) for v in levels})


def present_flag(df: DataFrame, column: str, level: str, out: str) -> DataFrame:
    """1 where the level stands, else 0; null is 0."""
    return df.withColumn(out, F.coalesce((F.col(column) == level).cast("int"), F.lit(0)))


def levels_of(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The distinct non-null levels in ascending order; over ``most`` of them is an error."""
    found = df.filter(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has over {most} levels: hash or count them instead")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, column: str, levels: Sequence | None = None) -> DataFrame:
    """``<column>_<level>`` for each level; null is 0 in all."""
    levels = levels_of(df, column) if levels is None else levels
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in levels})


def _lookup(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Join levels (column ``_level``) back; null has its own level."""
    return df.join(levels, F.col(column).eqNullSafe(F.col("_level")), "left").drop("_level")


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """The level's place from 0 in ascending order; null stays null."""
    levels = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_level")).distinct()
    return _lookup(df, column, key_rank(levels, ["_level"], out).withColumn(out, (F.col(out) - 1).cast("int")))


def ordinal_encode(df: DataFrame, column: str, order: Mapping[str, int], out: str) -> DataFrame:
    """A fixed map; unmapped values become null."""
    mapped = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, F.try_element_at(mapped, F.col(column)))


def binary_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """The label code in base 2, without leading zeros."""
    return label_encode(df, column, "_code").withColumn(out, F.bin("_code")).drop("_code")


def count_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    levels = df.groupBy(F.col(column).alias("_level")).agg(F.count(F.lit(1)).alias(out))
    return _lookup(df, column, levels)


def target_encode(df: DataFrame, column: str, target: str, out: str) -> DataFrame:
    """The mean target of the level over the whole table."""
    levels = df.groupBy(F.col(column).alias("_level")).agg(F.avg(F.col(target).cast("double")).alias(out))
    return _lookup(df, column, levels)


def target_encode_out_of_fold(df: DataFrame, column: str, target: str, fold: str, out: str) -> DataFrame:
    """The mean target of the level over the other folds; null where there is none."""
    cells = df.groupBy(F.col(column).alias("_level"), F.col(fold).alias("_fold")).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    over = Window.partitionBy("_level")
    rest = cells.select("_level", "_fold", F.try_divide(F.sum("s").over(over) - F.col("s"), F.sum("n").over(over) - F.col("n")).alias(out))
    same = F.col(column).eqNullSafe(F.col("_level")) & (F.col(fold) == F.col("_fold"))
    return df.join(rest, same, "left").drop("_level", "_fold")


def hash_bucket(column: str, buckets: int) -> Column:
    """The hashing trick: eight hex digits of md5, modulo the bucket count."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(column)), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def cross(a: str, b: str) -> Column:
    return F.concat_ws("_", F.col(a), F.col(b))


def unknown_level(df: DataFrame, column: str, known: DataFrame, out: str, name: str = "UNKNOWN") -> DataFrame:
    """Levels that ``known`` (a column of the same name) lacks become ``name``."""
    levels = known.select(F.col(column).alias("_level")).distinct().withColumn(out, F.col("_level"))
    return df.join(levels, F.col(column) == F.col("_level"), "left").drop("_level").withColumn(out, F.coalesce(out, F.lit(name)))
