"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Stands for a null id wherever ids are join or sort keys.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of ``separators`` (a regex class)."""
    return F.array_remove(F.split(text, separators), "")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset a
    temporary one is made in local mode; on a cluster it is an error, as the
    executors could not read it.  Unlike a checkpoint the written table tells
    the optimizer its true size, round after round of a loop.
    """
    path = _shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``durable`` in buckets of ``key``, as many as shuffle partitions: a join on it leaves these rows where they are.

    The table's name is dropped at once; its files stay, like those of ``durable``.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(total_parts(df), key).option("path", _shared_path(spark)).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"drop table {name}")
    return kept


def _shared_path(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoint-")


def total_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parts_within(df: DataFrame, keys: Sequence[str], weight: Column, bound: int) -> int:
    """How many parts by ``pmod(xxhash64(keys), parts)`` keep a part's summed ``weight`` within ``bound``.

    A part of a single row may exceed it.  Only sums reach the driver.
    """
    if (df.agg(F.sum(weight)).first()[0] or 0) <= bound:
        return 1
    parts = 2
    while True:
        sums = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("part")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
        if (sums.filter("n > 1").agg(F.max("w")).first()[0] or 0) <= bound:
            return parts
        parts *= 2


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str, sizes: DataFrame | None = None,
                total: int | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row a key; no key is one task.

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


def join_buckets(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """``join_spread`` to a ``bucketed`` table, which has one row a key; its rows move only for the keys that need a salt."""
    sizes = durable(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    limit = max(100, total // (4 * total_parts(left)))
    heavy = [r[0] for r in sizes.filter(F.col("_n") > limit).select(key).collect()]
    if not heavy:
        return left.hint("shuffle_hash").join(right, key)
    is_heavy = F.col(key).isin(heavy)
    light = left.filter(~is_heavy).hint("shuffle_hash").join(right, key)
    return light.unionByName(join_spread(left.filter(is_heavy), right.filter(is_heavy), [key], spread, sizes, total))
