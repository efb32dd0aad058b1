"""Reproducible splits: rows are ordered by the md5 of id and seed.

The order is the same in any engine and on any cluster; ranks are taken in
ranges of the digest, so no split sorts all rows in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import half_even, md5_key, uniform
from ..functions.ordered import ordered_rank, quantiles, shuffled_rank


def random_split(df: DataFrame, row_id: str, ratio: float = 0.8, seed: str = "42") -> DataFrame:
    """``is_train`` for exactly floor(ratio * n) rows."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    cut = math.floor(ratio * df.count())
    return shuffled_rank(df, [row_id], seed).withColumn("is_train", F.col("rn") <= cut).drop("rn")


def _by_class(df: DataFrame, row_id: str, label: str, seed: str) -> DataFrame:
    """``rn`` in the row's class, and ``class_n``, the class's size."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("class_n"))
    ranked = shuffled_rank(df, [row_id], seed, [label])
    return ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def stratified_split(df: DataFrame, row_id: str, label: str, test_ratio: float = 0.2, seed: str = "42") -> DataFrame:
    """``is_test``: of each class half-even(n * ratio) rows, at least one, never all of two or more."""
    n = F.col("class_n")
    cut = F.greatest(F.lit(1.0), half_even(n * test_ratio))
    cut = F.when(n > 1, F.least(cut, n - 1)).otherwise(cut)
    return _by_class(df, row_id, label, seed).withColumn("is_test", F.col("rn") <= cut).drop("rn", "class_n")


def stratified_split_train_rounded(df: DataFrame, row_id: str, label: str, train_ratio: float = 0.8, seed: str = "42") -> DataFrame:
    """The variant that rounds the train part; ``is_train``."""
    cut = half_even(F.col("class_n") * train_ratio)
    return _by_class(df, row_id, label, seed).withColumn("is_train", F.col("rn") <= cut).drop("rn", "class_n")


def stratified_split3(df: DataFrame, row_id: str, label: str, train: float = 0.6, validation: float = 0.2, test: float = 0.2, seed: str = "42") -> DataFrame:
    """``part``: train, validation or test; each has a row of any class of three or more."""
    if abs(train + validation + test - 1) > 1e-10:
        raise ValueError("ratios must sum to 1")
    n = F.col("class_n")
    many = n >= 3
    a = half_even(n * train)
    a = F.when(many, F.greatest(F.lit(1.0), F.least(a, n - 2.0))).otherwise(a)
    b = half_even(n * validation)
    b = F.when(many, F.greatest(F.lit(1.0), F.least(b, n - a - 1.0))).otherwise(F.least(b, n - a))
    part = F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "validation").otherwise("test")
    return _by_class(df, row_id, label, seed).withColumn("part", part).drop("rn", "class_n")


def stratified_folds(df: DataFrame, row_id: str, label: str, k: int = 5, seed: str = "42") -> DataFrame:
    """``fold`` from 0: shuffled in the class, then dealt round."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0]
    if k < 2 or smallest is None or k > smallest:
        raise ValueError("k must be at least 2 and at most the smallest class")
    ranked = shuffled_rank(df, [row_id], seed, [label])
    return ranked.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def contiguous_folds(df: DataFrame, order: str, k: int = 5) -> DataFrame:
    """``fold`` of n // k consecutive rows; the n % k last ones are -1, always train."""
    size = df.count() // k
    fold = F.floor((F.col("rn") - 1) / max(size, 1)).cast("int")
    return ordered_rank(df, order).withColumn("fold", F.when(fold < k, fold).otherwise(F.lit(-1))).drop("rn")


def repeated_splits(df: DataFrame, row_id: str, repeats: int, ratio: float = 0.8, seed: str = "42") -> DataFrame:
    """``split`` 0..repeats-1 and ``is_train``: a random split for each."""
    many = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    cut = math.floor(ratio * df.count())
    ranked = shuffled_rank(many, [row_id], seed, ["split"]) if repeats == 1 else _seeded_rank(many, row_id, seed)
    return ranked.withColumn("is_train", F.col("rn") <= cut).drop("rn")


def split_flags(df: DataFrame, row_id: str, repeats: int, ratio: float = 0.8, seed: str = "42") -> DataFrame:
    """``df`` with ``is_train``: an array with a flag for each of ``repeated_splits``; ids are distinct."""
    ids = repeated_splits(df.select(row_id), row_id, repeats, ratio, seed)
    flags = F.array_sort(F.collect_list(F.struct("split", "is_train")))  # one a split
    return df.join(ids.groupBy(row_id).agg(F.transform(flags, lambda s: s["is_train"]).alias("is_train")), row_id)


def _seeded_rank(df: DataFrame, row_id: str, seed: str) -> DataFrame:
    return shuffled_rank(df.withColumn("_own", F.concat_ws("-", F.col(row_id).cast("string"), F.col("split").cast("string"))), ["_own"], seed, ["split"]).drop("_own")


def time_split(df: DataFrame, time: str, ratio: float = 0.8) -> DataFrame:
    """``is_train``: not after the time at the given exact percentile."""
    stamp = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    cut = quantiles(df.select(stamp.alias("t")), ["t"], [ratio])["t"][0]
    return df.withColumn("is_train", stamp <= F.lit(cut).cast("double"))


def group_split(df: DataFrame, group: str, ratio: float = 0.8, seed: str = "42") -> DataFrame:
    """``is_train`` drawn once a group: a group is never cut."""
    return df.withColumn("is_train", uniform(md5_key([group], seed)) < ratio)


def deduplicate_first(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """The row with the smallest id of each set of equal rows."""
    first = df.groupBy(*columns).agg(F.min(row_id).alias("_first"))
    return df.join(first.select("_first"), F.col(row_id) == F.col("_first"), "left_semi")


def sample_per_class(df: DataFrame, row_id: str, label: str, k: int, seed: str = "42") -> DataFrame:
    """k rows of each class, by the md5 order."""
    order = Window.partitionBy(label).orderBy(md5_key([row_id], seed), row_id)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")


def shuffled(df: DataFrame, row_id: str, seed: str = "42") -> DataFrame:
    return df.orderBy(md5_key([row_id], seed), row_id)


def in_fold(fold: str, i: int) -> tuple[Column, Column]:
    """(train, validation) predicates of fold i."""
    return F.col(fold) != i, F.col(fold) == i
