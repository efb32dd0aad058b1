"""Joins in which no key is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def total_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str, sizes: DataFrame | None = None,
                total: int | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has few rows a key; no key is one task.

    Keys that hold more than a ``1 / (4 * partitions)`` share of ``left`` (and
    over 100 rows) are dealt by a hash of the column ``spread`` to one salt a
    partition, and their rows of ``right`` go to every salt.  There are at most
    ``4 * partitions`` such keys; the driver gathers their hashes, nothing more,
    and the plan is the same whether there are any.
    ``sizes`` has the number of rows of each key as ``_n`` and ``total`` their
    sum, where the caller knows them.  Keys are not null.
    """
    parts, keys = total_parts(left), list(keys)
    if sizes is None:
        sizes = durable(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    if total is None:
        total = sizes.agg(F.sum("_n")).first()[0] or 0
    limit = max(100, total // (4 * parts))
    heavy = [r[0] for r in sizes.filter(F.col("_n") > limit).select(F.xxhash64(*keys)).collect()]
    is_heavy = F.xxhash64(*keys).isin(heavy) if heavy else F.lit(False)
    salt = F.when(is_heavy, F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.withColumn("_salt", salt)
    copied = right.withColumn("_salt", F.explode(salts))
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
