"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_spread


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame, own: bool) -> DataFrame:
    """Of every u its number of edges _n and its smallest neighbour m (or itself, if ``own``)."""
    m = F.least(F.col("u"), F.min("v")) if own else F.min("v")
    return durable(edges.groupBy("u").agg(m.alias("m"), F.count(F.lit(1)).alias("_n")))


def _to_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(v, m) of every edge whose v is not m, the smallest neighbour of u; hubs are split."""
    joined = join_spread(edges, least.select("u", "m"), ["u"], "v", least.select("u", "_n"), total).filter("v <> m")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v of one type with an order).

    ``root`` is the smallest node reachable.  Large-star joins every larger
    neighbour of a node to the node's smallest neighbour, small-star every
    smaller one; both keep components and reach stars in few rounds.  A round
    works on an edge list no longer than the first and ends in a checkpoint.
    The edges of a hub are dealt to many tasks.
    """
    e = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(e)
    for _ in range(max_rounds):
        back = e.select(F.col("v").alias("u"), F.col("u").alias("v"))  # to the larger ones; u > v in e
        e = durable(_to_least(back, _least(e.unionByName(back), True), 2 * before[0]).distinct())
        least = _least(e, False)
        e = durable(_to_least(e, least, before[0]).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == before:
            roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
