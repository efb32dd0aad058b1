"""DBSCAN without a scan order and without pairs of rows.

Clusters are the connected components of the core rows' radius graph, numbered
by their smallest core row; a border row takes the smallest number among its
core neighbours; all else is noise (-1).

Rows lie in cells with sides of eps / sqrt(d).  All rows of a cell with
``min_samples`` rows are core; the few rows of other cells count what lies around
them box by box.  All core rows of a cell are one cluster, so components are
formed of cells, linked by one pair of core points within eps; and only rows
that are not core look for a core row in the cells around.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.ordered import ordered_rank
from ..functions.spread import join_spread
from .cells import Grid, distinct_points
from .silhouette import penalised_silhouette


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root): the smallest id reachable over ``edges`` (a, b, both ways)."""
    labels = durable(nodes.select("id", F.col("id").alias("root")))
    edges = durable(edges)
    for _ in range(max_rounds):
        seen = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("seen"))
        lower = labels.join(seen, F.col("id") == F.col("a"), "left").select("id", F.least("root", F.coalesce("seen", "root")).alias("root"))
        jump = lower.select(F.col("id").alias("j_id"), F.col("root").alias("j_root"))
        new = durable(lower.join(jump, F.col("root") == F.col("j_id")).select("id", F.col("j_root").alias("root")))
        changed = new.alias("n").join(labels.alias("o"), "id").filter(F.col("n.root") != F.col("o.root")).limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")


def _neighbours(grid: Grid, most: int) -> DataFrame:
    """(pid, near): how many rows lie within the radius of each point in a cell of fewer than ``most`` rows."""
    sparse = grid.points.join(grid.cells.filter(F.col("n") < most), "cell").select("pid", "x", "cell", "n")
    sent = sparse.join(grid.pairs, F.col("cell") == F.col("a")).select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("b").alias("cell"))
    around = grid.count_within(durable(sent), grid.points).groupBy("qid").agg(F.sum("n").alias("more"))
    return sparse.join(around, F.col("pid") == F.col("qid"), "left").select("pid", (F.col("n") + F.coalesce("more", F.lit(0))).alias("near"))


def _clusters(grid: Grid, neighbours: DataFrame, min_samples: int) -> DataFrame:
    """(pid, x, cluster) of the points that are no noise."""
    points = grid.points.join(grid.cells, "cell").join(neighbours, "pid", "left")
    points = durable(points.withColumn("core", (F.col("n") >= min_samples) | (F.coalesce("near", F.lit(0)) >= min_samples)).select("pid", "x", "w", "cell", "core"))
    core = points.filter("core")
    cells = durable(core.groupBy("cell").agg(F.min("pid").alias("id")))
    links = grid.linked(core).join(cells.select(F.col("cell").alias("a"), F.col("id").alias("ia")), "a").join(cells.select(F.col("cell").alias("b"), F.col("id").alias("ib")), "b")
    both = links.select(F.explode(F.array(F.struct(F.col("ia").alias("a"), F.col("ib").alias("b")), F.struct(F.col("ib").alias("a"), F.col("ia").alias("b")))).alias("e")).select("e.a", "e.b")
    roots = components(cells.select("id"), both)
    numbers = ordered_rank(roots.select("root").distinct(), "root", name="cluster").withColumn("cluster", (F.col("cluster") - 1).cast("int"))
    cells = durable(cells.join(roots.join(numbers, "root").select("id", "cluster"), "id").select("cell", "cluster"))

    rest = points.filter("not core")
    here = rest.join(cells, "cell").select("pid", "cluster")  # a core row of the own cell is near
    around = rest.join(grid.pairs, F.col("cell") == F.col("a")).select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("b").alias("cell"))
    around = durable(around.join(cells, "cell", "left_semi"))
    there = grid.count_within(around, core).join(cells, "cell").select(F.col("qid").alias("pid"), "cluster")
    border = here.unionByName(there).groupBy("pid").agg(F.min("cluster").alias("cluster"))
    inner = join_spread(core.select("pid", "x", "cell"), cells, ["cell"], "pid", grid.cells.withColumnRenamed("n", "_n")).select("pid", "x", "cluster")
    return inner.unionByName(rest.join(border, "pid").select("pid", "x", "cluster"))


def _labelled(df: DataFrame, row_id: str, columns: Sequence[str], grid: Grid, clusters: DataFrame) -> DataFrame:
    """(id, cluster) of every row; those of one point share its label."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(row_id).alias("id"), x.alias("_x"))
    whole = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v))
    placed = rows.filter(whole).select("id", F.col("_x").alias("x"))
    found = join_spread(placed, clusters.select("x", "cluster"), ["x"], "id", grid.points.select("x", F.col("w").alias("_n")), how="left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return found.unionByName(rows.filter(~whole).select("id", F.lit(-1).alias("cluster")))


def fit_predict(df: DataFrame, row_id: str, columns: Sequence[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, cluster); a row counts itself among its neighbours, one with a null or NaN coordinate is noise."""
    grid = Grid(distinct_points(df, row_id, columns), len(columns), eps)
    return _labelled(df, row_id, columns, grid, _clusters(grid, _neighbours(grid, min_samples), min_samples))


def explore(df: DataFrame, row_id: str, columns: Sequence[str], eps_values: Sequence[float], min_samples: Sequence[int]) -> list[tuple[float, int, int, float]]:
    """(eps, min_samples, clusters, penalised silhouette); neighbours are counted once for each eps."""
    points, out = durable(distinct_points(df, row_id, columns)), []
    for eps in eps_values:
        grid = Grid(points, len(columns), eps)
        near = durable(_neighbours(grid, max(min_samples)))
        for m in min_samples:
            labels = durable(_labelled(df, row_id, columns, grid, _clusters(grid, near, m)))
            n = labels.filter("cluster >= 0").select("cluster").distinct().count()
            joined = df.join(labels, F.col(row_id) == F.col("id"))
            out.append((eps, m, n, penalised_silhouette(joined, row_id, F.array(*[F.col(c).cast("double") for c in columns]), "cluster")))
    return out
