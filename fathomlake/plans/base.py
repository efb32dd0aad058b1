"""Registration of queries and shared pieces of the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has any."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles; counts are bigints."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(rounded(c, digits).alias(name) if kind == "double" else c)
    return df.select(*out)


def key_sql(ids: str, seed: str = "42") -> str:
    """The md5 shuffle key in SQL; ``ids`` is a text expression."""
    return f"md5({ids} || '-{seed}')"


def uniform_sql(key: str, at: int = 1) -> str:
    return f"(('0x' || substr({key}, {at}, 8))::bigint / 4294967296.0::double)"


def r(expression: str, digits: int = 6) -> str:
    """A rounded double without negative zero, in SQL."""
    return f"(round(({expression})::double, {digits}) + 0.0::double)"


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# Tables with dirt put in by a rule, the same in both engines.
LINES_SQL = """(select l_orderkey * 10 + l_linenumber as line_id, l_returnflag, l_linestatus,
  case when l_orderkey % 10 = 3 then null else l_quantity end as quantity,
  case when l_partkey % 7 = 2 then null else l_extendedprice end as price,
  case when l_suppkey % 5 = 1 then null else l_discount end as discount,
  case when l_orderkey % 9 = 4 then -l_tax else l_tax end as tax from lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with injected nulls and negatives."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_returnflag", "l_linestatus",
        F.when(F.col("l_orderkey") % 10 != 3, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_partkey") % 7 != 2, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_suppkey") % 5 != 1, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_orderkey") % 9 == 4, -F.col("l_tax")).otherwise(F.col("l_tax")).alias("tax"),
    )


PARTS_SQL = """(select p_partkey, p_brand, p_type, p_size, p_retailprice,
  case when p_partkey % 6 = 1 then null else p_size end as size_n,
  case when p_partkey % 11 = 3 then null else p_retailprice end as price_n from part)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with injected nulls."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice",
        F.when(F.col("p_partkey") % 6 != 1, F.col("p_size")).alias("size_n"),
        F.when(F.col("p_partkey") % 11 != 3, F.col("p_retailprice")).alias("price_n"),
    )


SCORED_SQL = """(select l.doc_id, l.toxic, l.quality, (d.n_chars % 101)::double / 100 as score,
  case when d.n_chars % 101 >= 50 then 1 else 0 end as pred from labels l join documents d using (doc_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with a rule-based score and prediction from the document's length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        "doc_id", "toxic", "quality", ((F.col("n_chars") % 101).cast("double") / 100).alias("score"),
        F.when(F.col("n_chars") % 101 >= 50, 1).otherwise(0).alias("pred"))
