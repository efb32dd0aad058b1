"""Silhouette scores with exact mean distances, in blocks.

Equal vectors of one cluster are one point.  Points are dealt to shards; each
task takes a pair of shards and sums the distances by cluster for both sides, so
what is shuffled is a row a point, cluster and shard, never a pair.  The work
grows with the square of the number of points: all distances are needed.  In the
plane they need not be formed one by one (``plane``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.expr import as_col
from ..functions.spread import join_spread, total_parts
from . import plane

FEW_POINTS = 20_000


def distances(x: np.ndarray, y: np.ndarray) -> Callable[[slice, slice], np.ndarray]:
    """The Euclidean distances of tiles of x and y, by matrix products; where those cancel, by the differences."""
    if x.shape[1] <= 3:

        def low(i: slice, j: slice) -> np.ndarray:
            d = np.zeros((i.stop - i.start, j.stop - j.start))
            for k in range(x.shape[1]):
                e = x[i, k, None] - y[j, k]
                d += np.square(e, out=e)
            return np.sqrt(d, out=d)

        return low
    centre = y.mean(axis=0)
    u, v = x - centre, y - centre
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    left, right = np.column_stack([u * -2, uu, np.ones(len(u))]), np.column_stack([v, np.ones(len(v)), vv])

    def tile(i: slice, j: slice) -> np.ndarray:
        d = left[i] @ right[j].T
        if not d.min() >= 1e-6 * (uu[i].max() + vv[j].max()):
            a, b = np.nonzero(~(d >= 1e-6 * (uu[i, None] + vv[j])))
            xs, ys = x[i], y[j]
            for at in range(0, len(a), 65_536):
                k, m = a[at : at + 65_536], b[at : at + 65_536]
                d[k, m] = ((xs[k] - ys[m]) ** 2).sum(axis=1)
        return np.sqrt(d, out=d)

    return tile


def _members(c: np.ndarray, w: np.ndarray, plain: bool) -> Callable[[slice], tuple[np.ndarray, np.ndarray | None]]:
    """For a tile of points sorted by cluster: where each cluster begins, and a row a cluster with the weights of its points."""
    out = {}

    def tile(at: slice) -> tuple[np.ndarray, np.ndarray | None]:
        if at.start not in out:
            mine = c[at]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            out[at.start] = first, None if plain or len(first) > 128 else (mine[first, None] == mine) * w[at]
        return out[at.start]

    return tile


def _block_sums(a: pd.DataFrame, b: pd.DataFrame, size: int = 256) -> pd.DataFrame:
    """point, other, total of the points of a by the clusters of b, and the other way round unless both are one shard."""
    a, b = a.sort_values("c", kind="stable"), b.sort_values("c", kind="stable")
    x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
    own, place = np.unique(a["c"].to_numpy(), return_inverse=True)
    clusters, other = np.unique(b["c"].to_numpy(), return_inverse=True)
    wa, wb = a["w"].to_numpy(np.float64), b["w"].to_numpy(np.float64)
    once = a["a"].iloc[0] == a["b"].iloc[0]
    of_a, of_b = np.zeros((len(x), len(clusters))), np.zeros((len(own), len(y)))
    with np.errstate(all="ignore"):
        plain = not max(np.abs(x).max(), np.abs(y).max()) < 1e150  # products would carry one that is not finite to all clusters
        tile, of_x, of_y = distances(x, y), _members(place, wa, plain), _members(other, wb, plain)
        for left in range(0, len(y), size):  # small tiles stay in the cache
            columns = slice(left, min(left + size, len(y)))
            starts, weights = of_y(columns)
            for at in range(0, len(x), size):
                rows = slice(at, min(at + size, len(x)))
                d = tile(rows, columns)
                of_a[rows, other[left + starts]] += np.add.reduceat(d * wb[columns], starts, axis=1) if weights is None else d @ weights.T
                if not once:
                    first, weight = of_x(rows)
                    of_b[place[at + first], columns] += np.add.reduceat(d * wa[rows, None], first, axis=0) if weight is None else weight @ d
    out = [(np.repeat(a["point"].to_numpy(), len(clusters)), np.tile(clusters, len(x)), of_a.ravel())]
    if not once:
        out.append((np.tile(b["point"].to_numpy(), len(own)), np.repeat(own, len(y)), of_b.ravel()))
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("point", "other", "total"), zip(*out, strict=True), strict=True)})


def _distance_sums(points: DataFrame, rows: int = 32_768) -> DataFrame:
    """point, other (a cluster), total distance to its rows: of points (point, c, v, w), each standing for w rows.

    Each pair of shards is the work of one task, for both sides at once; more than
    ``FEW_POINTS`` points of the plane have a way without pairs.
    """
    total, least, most, fine, *corners = points.agg(
        F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v")), F.min(F.forall("v", lambda x: F.coalesce(F.abs(x) < 1e150, F.lit(False)))),
        *[f(F.get("v", F.lit(i))) for f in (F.min, F.max) for i in (0, 1)]).first()
    if total > FEW_POINTS and least == most == 2 and fine:
        return plane.distance_sums(points, tuple(corners[:2]), tuple(corners[2:]))
    n = max(1, -(-total // rows), min(math.ceil(2 * math.sqrt(total_parts(points))), -(-total // 1024)))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("point"), F.lit(n)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = dealt.select("point", "c", "v", "w", "shard", F.least("shard", "i").alias("a"), F.greatest("shard", "i").alias("b"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["point", "other", "total"])
        return _block_sums(a, b)

    # by number: a task is small in bytes and long in time, so partitions must not be put together by their bytes
    dealt_to = max(total_parts(points), n * (n + 1))
    left, right = (met.filter(F.col("shard") == F.col(s)).drop("shard").repartition(dealt_to, "a", "b").groupBy("a", "b") for s in ("a", "b"))
    found = left.cogroup(right).applyInPandas(sums, "point bigint, other int, total double")
    return found.groupBy("point", "other").agg(F.sum("total").alias("total"))


def point_scores(df: DataFrame, row_id: str, vector: str | Column, cluster: str) -> DataFrame:
    """id, cluster, a, b, s of every row that is not noise (-1).

    A row alone in its cluster has a = 0.  Equal vectors of one cluster are one
    point, so copies cost nothing.
    """
    v = F.transform(as_col(vector), lambda x: x.cast("double"))
    given = df.filter(F.col(cluster) >= 0).select(F.col(row_id).cast("long").alias("id"), F.col(cluster).cast("int").alias("c"), v.alias("v"))
    points = durable(given.groupBy("c", "v").agg(F.count(F.lit(1)).alias("w")).withColumn("point", F.monotonically_increasing_id()))
    sizes = points.groupBy(F.col("c").alias("other")).agg(F.sum("w").alias("n"))
    totals = durable(_distance_sums(points))
    rows = join_spread(given, points, ["c", "v"], "id", points.withColumnRenamed("w", "_n")).select("id", "point", F.col("c").alias("own"))
    met = join_spread(rows, totals, ["point"], "id", points.select("point", F.col("w").alias("_n"))).join(sizes, "other")
    sums = met.groupBy("id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("own") == F.col("other")
    per = sums.groupBy("id", F.col("own").alias("cluster")).agg(
        F.max(F.when(own, F.coalesce(F.try_divide(F.col("total"), F.col("n") - 1), F.lit(0.0)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    return per.withColumn("s", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))


def silhouette(df: DataFrame, row_id: str, vector: str | Column, cluster: str) -> float:
    """The mean over all rows but noise; -1 unless there are two clusters."""
    if df.filter(F.col(cluster) >= 0).select(cluster).distinct().limit(2).count() < 2:
        return -1.0
    return point_scores(df, row_id, vector, cluster).agg(F.avg("s")).first()[0]


def penalised_silhouette(df: DataFrame, row_id: str, vector: str | Column, cluster: str) -> float:
    """The silhouette times the share of rows that are not noise."""
    noise = df.agg(F.avg((F.col(cluster) == -1).cast("double"))).first()[0] or 0.0
    return silhouette(df, row_id, vector, cluster) * (1 - noise)
