"""Points in cells: counts and links within a radius without pairs of rows.

Equal points are one point with a weight.  Cells are so small that any two of
their points lie within the radius.  What lies in other cells is judged by the
tight box around its points: wholly within the radius, wholly beyond, or
undecided; undecided boxes are cut into boxes of a quarter of the side until
they are decided or hold few points, which are compared one by one.  So a dense
cell costs a row for each box, not a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.spread import join_spread

#: Boxes of so many distinct points are compared point by point.
FEW = 64
#: A coordinate is cut into quarters at most so often (4 ** 26 parts: doubles have no more).
LEVELS = 26


def distinct_points(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """pid, x, w: the smallest id of each point and its number of rows; rows with a null or NaN coordinate go."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(row_id).alias("id"), x.alias("x")).filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    return rows.groupBy("x").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"))


class Grid:
    """Points (pid, x, w) in cells whose points lie within ``radius`` of each other."""

    def __init__(self, points: DataFrame, dims: int, radius: float) -> None:
        if not radius > 0:
            raise ValueError(f"the radius is {radius}, not above 0")
        self.dims, self.radius = dims, radius
        self.side = radius / math.sqrt(dims) * (1 - 1e-9)
        cell = F.array(*[F.floor(F.col("x")[i] / self.side).cast("long") for i in range(dims)])
        self.points = durable(points.withColumn("cell", cell))
        self.cells = durable(self.points.groupBy("cell").agg(F.sum("w").alias("n")))
        self.pairs = durable(self._pairs())

    def _pairs(self) -> DataFrame:
        """(a, b): ordered pairs of different cells that may hold points within the radius."""
        apart = int(math.sqrt(self.dims) * (1 + 1e-6)) + 1  # the largest difference of their numbers
        some = range(min(3, self.dims))

        def bucketed(name: str, reach: tuple[int, ...]) -> DataFrame:
            out = self.cells.select(F.col("cell").alias(name))
            for i in some:
                own = F.floor(F.col(name)[i] / apart).cast("long")
                out = out.withColumn(f"k{i}", F.explode(F.array(*[own + r for r in reach])))
            return out

        met = bucketed("a", (-1, 0, 1)).join(bucketed("b", (0,)), [f"k{i}" for i in some])
        gaps = [F.greatest(F.abs(F.col("a")[i] - F.col("b")[i]) - 1, F.lit(0)) * self.side for i in range(self.dims)]
        near = _length(gaps) <= self.radius * (1 + 1e-6)
        return met.filter((F.col("a") != F.col("b")) & near).select("a", "b")

    def sub(self, level: int) -> Column:
        """The place of a point in its cell, in steps of side / 4 ** level."""
        share = [(F.col("x")[i] - F.col("cell")[i] * self.side) / self.side for i in range(self.dims)]
        return F.array(*[F.floor(s * float(4**level)).cast("long") for s in share])

    def boxes(self, points: DataFrame, level: int) -> DataFrame:
        """cell, sub, parent, n, size, low, high, one: the boxes of ``points`` (pid, x, w, cell) at a level."""
        ends = [F.array(*[f(F.col("x")[i]) for i in range(self.dims)]) for f in (F.min, F.max)]
        found = points.withColumn("sub", self.sub(level)).groupBy("cell", "sub").agg(
            F.sum("w").alias("n"), F.count(F.lit(1)).alias("size"), ends[0].alias("low"), ends[1].alias("high"), F.min(F.struct("pid", "x"))["x"].alias("one"))
        return found.withColumn("parent", F.transform("sub", lambda s: F.floor(s / 4)))

    def distance(self, a: Column, b: Column) -> Column:
        return _length([a[i] - b[i] for i in range(self.dims)])

    def count_within(self, sent: DataFrame, points: DataFrame, crowded: bool = False) -> DataFrame:
        """(qid, cell, n): rows of ``points`` in ``cell`` within the radius of qx, where there are any.

        ``sent`` has qid, qx and the cell to look at; ``crowded`` if many may
        look at one cell, which then are dealt to many tasks.
        """
        def met_with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
            return join_spread(left, right, keys, "qid") if crowded else left.join(right, keys)

        boxes, found = self.boxes(points, 0), []
        asked = met_with(sent, boxes, ["cell"])
        for level in range(LEVELS + 1):
            q, low, high = (F.col(c) for c in ("qx", "low", "high"))
            least = _length([F.greatest(low[i] - q[i], q[i] - high[i], F.lit(0.0)) for i in range(self.dims)])
            most = _length([F.greatest(F.abs(q[i] - low[i]), F.abs(q[i] - high[i])) for i in range(self.dims)])
            judged = durable(asked.withColumns({"least": least, "most": most}).filter(F.col("least") <= self.radius))
            inside = F.col("most") <= self.radius
            found.append(judged.filter(inside).select("qid", "cell", "n"))
            small = judged.filter(~inside & (F.col("size") <= FEW)).select("qid", "qx", "cell", "sub")
            own = points.withColumn("sub", self.sub(level)).select("cell", "sub", "x", "w")
            met = met_with(small, own, ["cell", "sub"]).filter(self.distance(F.col("qx"), F.col("x")) <= self.radius)
            found.append(met.groupBy("qid", "cell").agg(F.sum("w").alias("n")))
            large = judged.filter(~inside & (F.col("size") > FEW)).select("qid", "qx", "cell", F.col("sub").alias("parent"))
            if not large.limit(1).count():
                break
            asked = met_with(large, self.boxes(points, level + 1), ["cell", "parent"])
        whole = found[0]
        for f in found[1:]:
            whole = whole.unionByName(f)
        return whole.groupBy("qid", "cell").agg(F.sum("n").alias("n"))

    def linked(self, points: DataFrame) -> DataFrame:
        """(a, b): pairs of cells of ``points``, a before b, with two points within the radius."""
        cells = points.select("cell").distinct()
        pairs = self.pairs.filter(F.col("a") < F.col("b")).join(cells.withColumnRenamed("cell", "a"), "a", "left_semi").join(
            cells.withColumnRenamed("cell", "b"), "b", "left_semi")
        none = F.transform("a", lambda _: F.lit(0).cast("long"))
        open_pairs, found = pairs.select("a", "b", none.alias("pa"), none.alias("pb")), []
        for level in range(LEVELS + 1):
            boxes = durable(self.boxes(points, level))
            if not level:  # rounding may put a point just beyond its cell
                boxes = boxes.withColumn("parent", F.transform("sub", lambda _: F.lit(0).cast("long")))

            def side(name: str, boxes: DataFrame = boxes) -> DataFrame:
                return boxes.select(F.col("cell").alias(name), F.col("parent").alias(f"p{name}"), *[F.col(c).alias(f"{c}_{name}") for c in ("sub", "size", "low", "high", "one")])

            met = open_pairs.join(side("a"), ["a", "pa"]).join(side("b"), ["b", "pb"])
            gaps = [F.greatest(F.col("low_b")[i] - F.col("high_a")[i], F.col("low_a")[i] - F.col("high_b")[i], F.lit(0.0)) for i in range(self.dims)]
            judged = durable(met.filter(_length(gaps) <= self.radius).withColumn("hit", self.distance(F.col("one_a"), F.col("one_b")) <= self.radius).select(
                "a", "b", "sub_a", "sub_b", "size_a", "size_b", "hit"))
            hits = judged.filter("hit").select("a", "b").distinct()
            rest = judged.join(hits, ["a", "b"], "left_anti")
            own = points.withColumn("sub", self.sub(level))
            few = F.col("size_a") * F.col("size_b") <= FEW * FEW
            close = rest.filter(few)
            for name in ("a", "b"):
                close = close.join(own.select(F.col("cell").alias(name), F.col("sub").alias(f"sub_{name}"), F.col("x").alias(f"x_{name}")), [name, f"sub_{name}"])
            close = close.filter(self.distance(F.col("x_a"), F.col("x_b")) <= self.radius).select("a", "b").distinct()
            found.append(durable(hits.unionByName(close).distinct()))
            open_pairs = durable(rest.filter(~few).join(found[-1], ["a", "b"], "left_anti").select("a", "b", F.col("sub_a").alias("pa"), F.col("sub_b").alias("pb")))
            if not open_pairs.limit(1).count():
                break
        whole = found[0]
        for f in found[1:]:
            whole = whole.unionByName(f)
        return whole.distinct()


def _length(gaps: Sequence[Column]) -> Column:
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
