"""Class rebalancing with reproducible draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import md5_key, uniform
from ..functions.ordered import shuffled_rank
from .knn import nearest_rows


def _sizes(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def undersample(df: DataFrame, row_id: str, label: str, seed: str = "42") -> DataFrame:
    """Every class cut to the size of the smallest."""
    least = min(_sizes(df, label).values(), default=0)
    return shuffled_rank(df, [row_id], seed, [label]).filter(F.col("rn") <= least).drop("rn")


def _draws(sizes: Mapping, spark, label_type: str, seed: str) -> DataFrame:
    """A row for each synthetic row to make: label, class_n, draw, key."""
    most = max(sizes.values(), default=0)
    plan = spark.createDataFrame([(k, n, most - n) for k, n in sizes.items() if n < most], f"label {label_type}, class_n long, missing long")
    drawn = plan.select("label", "class_n", F.explode(F.sequence(F.lit(1), F.col("missing"))).alias("draw"))
    return drawn.withColumn("key", md5_key(["label", "draw"], seed))


def _pick(key, n, at: int = 1):
    return F.least(F.floor(uniform(key, at) * n) + 1, n).cast("long")


def oversample(df: DataFrame, row_id: str, label: str, seed: str = "42") -> DataFrame:
    """Originals, and rows drawn with replacement until all classes are as large.

    ``copy`` is 0 for an original and counts the draws of the class otherwise.
    """
    sizes = _sizes(df, label)
    draws = _draws(sizes, df.sparkSession, df.schema[label].dataType.simpleString(), seed)
    draws = draws.withColumn("rn", _pick(F.col("key"), F.col("class_n"))).select(F.col("label").alias("_label"), F.col("rn").alias("_rn"), F.col("draw").alias("copy"))
    ranked = shuffled_rank(df, [row_id], seed, [label])
    drawn = draws.join(ranked, (F.col("_label") == F.col(label)) & (F.col("_rn") == F.col("rn"))).select(*df.columns, "copy")
    return df.withColumn("copy", F.lit(0).cast("long")).unionByName(drawn.withColumn("copy", F.col("copy").cast("long")))


def smote(df: DataFrame, row_id: str, label: str, vector: str, k: int = 5, seed: str = "42") -> DataFrame:
    """Synthetic rows (label, draw, base, neighbour, alpha, vector) of small classes.

    A draw picks a base row and one of its k nearest rows of the class (fewer in
    a class of k rows or less; none in a class of one row, which yields copies)
    and goes a uniform part of the way.
    """
    sizes = _sizes(df, label)
    most = max(sizes.values(), default=0)
    draws = _draws(sizes, df.sparkSession, df.schema[label].dataType.simpleString(), seed)
    bases = shuffled_rank(df, [row_id], seed, [label]).select(F.col(label).alias("b_label"), F.col("rn"), F.col(row_id).alias("base"), F.col(vector).alias("u"))
    small = [value for value, n in sizes.items() if 1 < n < most]
    near = None
    if small:
        own = df.filter(F.col(label).isin(small))
        near = nearest_rows(own, own, row_id, vector, k, group=label).select("query_id", "rank", F.col("id").alias("neighbour"))
    chosen = draws.withColumn("rn", _pick(F.col("key"), F.col("class_n"), 1)).withColumn(
        "rank", _pick(F.col("key"), F.greatest(F.lit(1), F.least(F.lit(k), F.col("class_n") - 1)), 9)).withColumn("alpha", uniform(F.col("key"), 17))
    chosen = chosen.join(bases.withColumnRenamed("rn", "b_rn"), (F.col("label") == F.col("b_label")) & (F.col("rn") == F.col("b_rn")))
    if near is None:
        return chosen.select("label", "draw", "base", F.col("base").alias("neighbour"), "alpha", F.col("u").alias("vector"))
    chosen = chosen.join(near.withColumnRenamed("rank", "n_rank"), (F.col("base") == F.col("query_id")) & (F.col("rank") == F.col("n_rank")), "left")
    others = df.select(F.col(row_id).alias("o_id"), F.col(vector).alias("v"))
    point = F.zip_with("u", F.coalesce("v", "u"), lambda a, b: a.cast("double") + F.col("alpha") * (b.cast("double") - a.cast("double")))
    return chosen.join(others, F.col("neighbour") == F.col("o_id"), "left").select(
        "label", "draw", "base", F.coalesce("neighbour", "base").alias("neighbour"), "alpha", point.alias("vector"))


def class_weights(df: DataFrame, label: str, weights: Mapping | None = None) -> DataFrame:
    """label, n, weight: n / (classes * n_c), or the given weights (else 1)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if weights:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        return counts.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("label")), F.lit(1.0)))
    over = Window.partitionBy(F.lit(0))  # a row a class
    return counts.withColumn("weight", F.sum("n").over(over) / (F.count(F.lit(1)).over(over) * F.col("n")))


def inverse_share_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: the inverse of the class's share."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.sum("n").over(Window.partitionBy(F.lit(0))) / F.col("n"))


def cut_to(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)
