"""Feature engineering."""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.spread import join_spread
from .cells import Grid, distinct_points


def center_distance(df: DataFrame, group: str, x: str, y: str, out: str) -> DataFrame:
    """Euclidean distance to the mean point of the row's group."""
    centres = df.groupBy(F.col(group).alias("_g")).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    gap = F.sqrt((F.col(x) - F.col("_x")) * (F.col(x) - F.col("_x")) + (F.col(y) - F.col("_y")) * (F.col(y) - F.col("_y")))
    return df.join(centres, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(out, gap).drop("_g", "_x", "_y")


def interaction_split(df: DataFrame, column: str, flag: str) -> DataFrame:
    """``<column>_1`` and ``<column>_0``: the value where the flag is so, else 0."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(flag) == v, F.col(column)).otherwise(F.lit(0.0)) for v in (1, 0)})


def powers(df: DataFrame, columns: Sequence[str], exponents: Sequence[int]) -> DataFrame:
    return df.withColumns({f"{c}_pow{p}": F.pow(F.col(c).cast("double"), F.lit(float(p))) for c in columns for p in exponents})


def monomials(columns: Sequence[str], degree: int) -> dict[str, Column]:
    """All products of powers up to a total degree, cross terms included: name -> column."""
    out: dict[str, Column] = {}
    for total in range(1, degree + 1):
        for chosen in combinations_with_replacement(columns, total):
            name = "_".join(f"{c}{chosen.count(c)}" for c in dict.fromkeys(chosen))
            out[name] = reduce(lambda a, c: a * c, [F.col(c).cast("double") for c in chosen])
    return out


def drawn_powers(columns: Sequence[str], draws: int = 300, exponents: tuple[int, int] = (2, 11), seed: int = 42) -> list[tuple[str, int]]:
    """Seeded draws of (column, exponent), spread over the columns; repeats fall together."""
    draw = random.Random(seed)
    each = max(1, draws // max(len(columns), 1))
    return sorted({(c, draw.randint(*exponents)) for c in columns for _ in range(each)})


def ratio(a: str, b: str) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def first_seen_delta(df: DataFrame, group: str, column: str, first: str, delta: str) -> DataFrame:
    """The group's smallest value, and how far the row is from it."""
    firsts = df.groupBy(F.col(group).alias("_g")).agg(F.min(column).alias(first))
    return df.join(firsts, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g").withColumn(delta, F.col(column) - F.col(first))


def interval_lookup(df: DataFrame, column: str, intervals: Sequence[tuple[int, float, float]], out: str) -> DataFrame:
    """The smallest key whose closed [min, max] holds the value, else null.

    ``intervals`` is a short literal list, tested in order without a join.
    """
    value = F.lit(None).cast("int")
    for key, low, high in sorted(intervals, reverse=True):
        value = F.when(F.col(column).between(low, high), F.lit(key)).otherwise(value)
    return df.withColumn(out, value)


def radius_neighbour_count(points: DataFrame, row_id: str, columns: Sequence[str], radius: float, out: str = "n_neighbours") -> DataFrame:
    """Rows within the radius, the row itself not counted; 0 for a row with a null or NaN coordinate.

    Rows of one point share a count, the rows of its cell are near without a
    comparison, and the cells around are counted box by box.
    """
    grid = Grid(distinct_points(points, row_id, columns), len(columns), radius)
    sizes = grid.cells.withColumnRenamed("n", "_n")
    sent = join_spread(grid.points, grid.pairs.withColumnRenamed("a", "cell"), ["cell"], "pid", sizes)
    sent = sent.select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("b").alias("cell"))
    around = grid.count_within(durable(sent), grid.points, crowded=True).groupBy("qid").agg(F.sum("n").alias("_more"))
    own = join_spread(grid.points, grid.cells, ["cell"], "pid", sizes).join(around, F.col("pid") == F.col("qid"), "left")
    counts = own.select("x", (F.col("n") + F.coalesce("_more", F.lit(0)) - 1).alias("_near"))
    x = F.array(*[F.col(c).cast("double") for c in columns])
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    found = join_spread(points.filter(whole).withColumn("_x", x), counts.withColumnRenamed("x", "_x"), ["_x"], row_id, grid.points.select(F.col("x").alias("_x"), F.col("w").alias("_n")))
    found = found.select(*points.columns, F.col("_near").alias(out))
    return found.unionByName(points.filter(~whole).withColumn(out, F.lit(0).cast("long")))
