"""Sums of distances of points in the plane, without all their pairs.

A square around the points is cut into quarters again and again.  Two boxes of
one size are compared point by point where they hold few points, are told apart
where another box of their size lies between them, and are cut on otherwise, so
the work grows with the points.  Over two boxes that are apart the distance is a
smooth function: it is interpolated at ``NODES`` x ``NODES`` Chebyshev nodes of
both (the tests hold the sums to a relative error of 1e-10).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.spread import total_parts

NODES = 14
#: Boxes with up to FEW * FEW pairs of points are compared point by point.
FEW = 64
LEVELS = 26
#: Points in a row of a block.
BLOCK = 256
_BLOCK = "level int, bx bigint, by bigint, c int, ids array<bigint>, xs array<double>, ys array<double>, ws array<double>"


@lru_cache(1)
def _nodes() -> np.ndarray:
    return np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)) / 2


def _shares(t: np.ndarray) -> np.ndarray:
    """A row a place in [-0.5, 0.5]: the share of each node in the interpolation there."""
    k = np.arange(NODES)
    at, own = (np.cos(np.arccos(np.clip(2 * x, -1, 1))[:, None] * k) for x in (t, _nodes()))
    at *= np.where(k, 2 / NODES, 1 / NODES)
    return at @ own.T


@lru_cache(64)
def _between(dx: int, dy: int) -> np.ndarray:
    """Distances from the nodes of a box of side 1 to those of the box dx, dy further."""
    x, y = (d + _nodes()[None, :] - _nodes()[:, None] for d in (dx, dy))
    return np.hypot(x[:, None, :, None], y[None, :, None, :]).reshape(NODES**2, NODES**2)


def _sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` and where the groups begin in it."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(fresh)


def _blocks(levels: list[int]):
    """Of point, c, w, x, y, ix, iy: the points of each box and cluster, for each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, c, w, x, y, ix, iy = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            for level in levels if len(point) else ():
                bx, by = ix >> (LEVELS - level), iy >> (LEVELS - level)
                order, first = _sorted_groups(bx, by, c)
                starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(first, [*first[1:], len(order)], strict=True)])
                at, ends = order[starts], pa.array(np.append(starts, len(order)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (point, x, y, w)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(bx[at]), pa.array(by[at]), pa.array(c[at]), *lists],
                                                 names=["level", "bx", "by", "c", "ids", "xs", "ys", "ws"])

    return run


class _Square:
    def __init__(self, x: float, y: float, width: float) -> None:
        self.x, self.y, self.width = x, y, width

    def place(self, value: Column, low: float) -> Column:
        return F.least(F.floor((value - low) / self.width * float(2**LEVELS)).cast("long"), F.lit(2**LEVELS - 1))

    def shares(self, level: int, bx: int, by: int, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = 2.0**level / self.width
        return _shares((xs - self.x) * parts - bx - 0.5), _shares((ys - self.y) * parts - by - 0.5)

    def moments(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The weights of blocks, moved to the nodes of their boxes."""
        for f in frames:
            q = []
            for level, bx, by, xs, ys, ws in zip(f["level"], f["bx"], f["by"], f["xs"], f["ys"], f["ws"], strict=True):
                u, v = self.shares(level, bx, by, xs, ys)
                q.append(((u * ws[:, None]).T @ v).ravel())
            yield f[["level", "bx", "by", "c"]].assign(q=q)

    def across(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of pairs of boxes apart, sorted by the first, with moments of the second: the sums of distances at the nodes of the first."""
        for f in frames:
            if f.empty:
                continue
            q, level = np.stack(f["q"].to_numpy()), f["level"].to_numpy()
            dx, dy = (f[f"b{k}"].to_numpy() - f[f"a{k}"].to_numpy() for k in "xy")
            out = np.empty_like(q)
            for i, j in set(zip(dx.tolist(), dy.tolist(), strict=True)):
                here = (dx == i) & (dy == j)
                out[here] = q[here] @ _between(i, j).T
            out *= (self.width / 2.0**level)[:, None]
            order, first = _sorted_groups(level, f["ax"].to_numpy(), f["ay"].to_numpy(), f["c"].to_numpy())
            sums = np.add.reduceat(out[order], first, axis=0)
            yield f.iloc[order[first]][["level", "ax", "ay", "c"]].rename(columns={"c": "other"}).assign(phi=list(sums))

    def inside(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of blocks with sums at the nodes of their boxes: the sums at their points."""
        for f in frames:
            found = []
            for level, bx, by, xs, ys, phi in zip(f["level"], f["ax"], f["ay"], f["xs"], f["ys"], f["phi"], strict=True):
                u, v = self.shares(level, bx, by, xs, ys)
                found.append(((u @ phi.reshape(NODES, NODES)) * v).sum(axis=1))
            yield _totals(f, found)


def _totals(f: pd.DataFrame, found: list[np.ndarray]) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"point": np.empty(0, np.int64), "other": np.empty(0, np.int32), "total": np.empty(0)})
    return pd.DataFrame({"point": np.concatenate(f["ids"].to_numpy()), "other": np.repeat(f["other"].to_numpy(), [len(t) for t in found]), "total": np.concatenate(found)})


def _direct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of two blocks: the sums of the distances from the points of the first to those of the second."""
    for f in frames:
        found = [np.hypot(x[:, None] - u, y[:, None] - v) @ w for x, y, u, v, w in zip(f["xs"], f["ys"], f["us"], f["vs"], f["ws"], strict=True)]
        yield _totals(f, found)


def _pairs(placed: DataFrame) -> tuple[DataFrame, list[int]]:
    """(level, ax, ay, bx, by, near) that hold every ordered pair of points once, and the levels."""
    found, levels, open_pairs = [], [], None
    for level in range(2, LEVELS + 1):
        up = LEVELS - level
        boxes = durable(placed.groupBy(F.shiftright("ix", up).alias("x"), F.shiftright("iy", up).alias("y")).agg(F.count(F.lit(1)).alias("n")))
        a, b = (boxes.select(F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), F.col("n").alias(f"n{s}")) for s in "ab")
        if open_pairs is None:
            met = a.crossJoin(b)  # of 16 boxes
        else:
            for s, side in (("a", a), ("b", b)):
                side = side.withColumns({f"p{s}x": F.shiftright(f"{s}x", 1), f"p{s}y": F.shiftright(f"{s}y", 1)})
                open_pairs = open_pairs.join(side, [f"p{s}x", f"p{s}y"])
            met = open_pairs
        apart = F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))) > 1
        near = F.lit(True) if level == LEVELS else F.col("na") * F.col("nb") <= FEW * FEW
        judged = durable(met.select(F.lit(level).alias("level"), "ax", "ay", "bx", "by", near.alias("near"), (~near & ~apart).alias("open")))
        found.append(judged.filter("not open").drop("open"))
        levels.append(level)
        open_pairs = judged.filter("open").select(*[F.col(f"{s}{k}").alias(f"p{s}{k}") for s in "ab" for k in "xy"])
        if open_pairs.isEmpty():
            break
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    return pairs, levels


def distance_sums(points: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """point, other (a cluster), total distance to its rows: of points (point, c, v, w) between the corners ``low`` and ``high``."""
    square = _Square(*low, max(high[0] - low[0], high[1] - low[1]) or 1.0)
    x, y = F.col("v")[0], F.col("v")[1]
    placed = points.select("point", "c", F.col("w").cast("double").alias("w"), x.alias("x"), y.alias("y"), square.place(x, low[0]).alias("ix"), square.place(y, low[1]).alias("iy"))
    bits = [F.shiftleft(F.shiftright(k, LEVELS - 1 - i).bitwiseAND(F.lit(1)), 2 * (9 - i) + s) for i in range(10) for s, k in enumerate(("ix", "iy"))]
    parts = total_parts(points)
    placed = durable(placed.repartitionByRange(parts, sum(bits[1:], bits[0])))  # rows of a box lie together
    pairs, levels = _pairs(placed)
    blocks = durable(placed.mapInArrow(_blocks(levels), _BLOCK))
    first = blocks.withColumnsRenamed({"bx": "ax", "by": "ay"}).select("level", "ax", "ay", "ids", "xs", "ys")

    near = pairs.filter("near").join(blocks.select("level", "bx", "by", F.col("c").alias("other"), F.col("xs").alias("us"), F.col("ys").alias("vs"), "ws"), ["level", "bx", "by"])
    near = near.join(first, ["level", "ax", "ay"]).select("ids", "xs", "ys", "other", "us", "vs", "ws").mapInPandas(_direct, "point bigint, other int, total double")

    far = pairs.filter("not near").drop("near")
    sources = blocks.join(far.select("level", "bx", "by").distinct(), ["level", "bx", "by"], "left_semi").select("level", "bx", "by", "c", "xs", "ys", "ws")
    moments = durable(sources.mapInPandas(square.moments, "level int, bx bigint, by bigint, c int, q array<double>"))
    met = far.join(moments, ["level", "bx", "by"]).repartition(parts, "level", "ax", "ay").sortWithinPartitions("level", "ax", "ay")
    phi = durable(met.mapInPandas(square.across, "level int, ax bigint, ay bigint, other int, phi array<double>"))
    reached = phi.join(first, ["level", "ax", "ay"]).select("level", "ax", "ay", "ids", "xs", "ys", "other", "phi").mapInPandas(square.inside, "point bigint, other int, total double")
    return near.unionByName(reached).groupBy("point", "other").agg(F.sum("total").alias("total"))
