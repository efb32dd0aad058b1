"""Exact nearest rows by pivots and the triangle inequality.

A bounded sample of rows serves as pivots; every row belongs to the cell of its
nearest pivot and keeps its distance to it.  Rows are sorted in ranges of (cell,
distance): a range is a shard, one that no key can outgrow.  A query first meets
the shard where its own distance lies in its own cell, which bounds the distance
of its k-th neighbour; then it is sent to those shards alone that the triangle
inequality does not exclude, and within a shard to the rows whose distance to
the pivot can lie within the bound.  A task holds one shard and streams the
queries past it, so rows are never copied for queries.

Of rows with one vector only the smallest ids can be among the k nearest, so the
others take no part: copies neither fill a shard nor widen a search.  Pivots
decide how much is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable

#: Pivots of a group at most, and rows of a shard (unless that makes over MAX_SHARDS).
PIVOTS = 256
SHARD_ROWS = 16384
MAX_SHARDS = 100_000
#: Room for rounding in the triangle inequality.
SLACK = 1e-9
#: The distance to a pivot of another group.
FAR = 1e300

_FOUND = "id bigint, v array<double>, cell int, d double, shard int, ids array<bigint>, distances array<double>, compared bigint"


def _vectors(df: DataFrame, row_id: str, features: Sequence[str] | str, group: str | None) -> DataFrame:
    if isinstance(features, str):
        v = F.transform(features, lambda x: x.cast("double"))
    else:
        v = F.array(*[F.col(c).cast("double") for c in features])
    g = F.lit("") if group is None else F.col(group).cast("string")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(usable & g.isNotNull()).select(F.col(row_id).cast("long").alias("id"), g.alias("g"), v.alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class _Cells:
    """Pivots, and the pieces that the ranges of rows make of their cells."""

    pivots: np.ndarray
    groups: np.ndarray
    shard: np.ndarray | None = None
    cell: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def distances(self, x: np.ndarray, groups: Sequence[str] | None = None, cells: np.ndarray | None = None) -> np.ndarray:
        """Of each vector to each pivot of its group; those of others are ``FAR``."""
        out = np.empty((len(x), len(self.pivots)))
        step = max(1, (1 << 22) // max(1, self.pivots.size))
        for a in range(0, len(x), step):
            gap = x[a : a + step, None, :] - self.pivots[None]
            out[a : a + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        own = np.asarray(groups, object) if groups is not None else self.groups[cells]
        out[own[:, None] != self.groups[None]] = FAR
        return out

    def least(self, far: np.ndarray, own: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """No row of a piece is nearer to the vector; ``far`` are its distances to the pivots."""
        there = far[..., cell]
        return np.maximum(np.maximum(there - high, low - there), (there - own[..., None]) / 2) - SLACK * (1 + there + high)


def _assigned(df: DataFrame, cells: _Cells) -> DataFrame:
    """id, v, cell, d: rows with the nearest pivot of their group; without one they go."""
    sent = df.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = sent.value.distances(_matrix(batch.column(2)), batch.column(1).to_pylist())
                cell = far.argmin(axis=1)
                d = far[np.arange(len(far)), cell]
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cell, pa.int32()), pa.array(d, pa.float64())], names=["id", "v", "cell", "d"])
                yield out.filter(pa.array(d < FAR))

    return df.mapInArrow(run, "id bigint, v array<double>, cell int, d double")


class _Shard:
    """The rows of a shard, sorted by (cell, d)."""

    def __init__(self, parts: list[tuple], cells: _Cells) -> None:
        self.ids, self.cell, self.d = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.x = np.concatenate([p[3] for p in parts])
        self.cells = cells
        self.firsts = np.flatnonzero(np.diff(self.cell, prepend=-1))
        self.ends = np.append(self.firsts[1:], len(self.cell))
        self.of = self.cell[self.firsts]

    def nearest(self, v: np.ndarray, far: np.ndarray, own: float, bound: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and distances of the k nearest within ``bound`` (ties to smaller ids), and how many rows were compared."""
        least = self.cells.least(far, np.float64(own), self.of, self.d[self.firsts], self.d[self.ends - 1])
        ids, distances, compared = np.zeros(0, np.int64), np.zeros(0), 0
        for i in np.argsort(least, kind="stable"):
            if least[i] > bound or far[self.of[i]] >= FAR:
                break
            a, b = self.firsts[i], self.ends[i]
            at = far[self.of[i]]
            if not np.isfinite(bound):  # the rows nearest to the query's own distance give a first bound
                near = np.searchsorted(self.d[a:b], at) + a
                some = self.x[max(a, near - k) : min(b, near + k)] - v
                compared += len(some)
                if len(some) >= k:
                    bound = float(np.partition(np.sqrt((some**2).sum(axis=1)), k - 1)[k - 1])
            room = bound + SLACK * (1 + at + bound)
            first, end = a + np.searchsorted(self.d[a:b], at - room), a + np.searchsorted(self.d[a:b], at + room, side="right")
            d = np.sqrt(((self.x[first:end] - v) ** 2).sum(axis=1))
            compared += len(d)
            few = np.flatnonzero(d <= bound)
            ids, distances = np.concatenate([ids, self.ids[first:end][few]]), np.concatenate([distances, d[few]])
            order = np.lexsort((ids, distances))[:k]
            ids, distances = ids[order], distances[order]
            if len(ids) == k:
                bound = min(bound, float(distances[-1]))
        return ids, distances, compared


def _visit(rows: DataFrame, queries: DataFrame, cells: _Cells, k: int, keep: bool) -> DataFrame:
    """The k nearest rows of each query in the shard it is sent to; with ``keep`` the query comes along."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def answered(part: pa.RecordBatch, shard: _Shard) -> pa.RecordBatch:
        x, cell, own = _matrix(part.column(3)), part.column(4).to_numpy(), part.column(5).to_numpy()
        far, bounds = sent.value.distances(x, cells=cell), part.column(6).to_numpy()
        found = [shard.nearest(x[i], far[i], own[i], bounds[i], k) for i in range(len(x))]
        v = part.column(3) if keep else pa.nulls(len(x), part.column(3).type)
        return pa.RecordBatch.from_arrays(
            [part.column(2), v, part.column(4), part.column(5), part.column(0), pa.array([f[0] for f in found], pa.list_(pa.int64())),
             pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.int64())],
            names=["id", "v", "cell", "d", "shard", "ids", "distances", "compared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at, shard = [], None, None
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if keys[0, a] != at:
                    parts, at, shard = [], keys[0, a], None
                if keys[1, a] == 0:
                    parts.append((part.column(2).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(3)).copy()))
                else:
                    shard = shard or _Shard(parts, sent.value)
                    yield answered(part, shard)

    left = rows.select("shard", F.lit(0).alias("kind"), "id", "v", "cell", "d", F.lit(0.0).alias("bound"))
    right = queries.select("shard", F.lit(1).alias("kind"), "id", "v", "cell", "d", "bound")
    both = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "kind", "cell", "d")
    return both.mapInArrow(run, _FOUND)


def _own_shard(queries: DataFrame, cells: _Cells) -> DataFrame:
    """Queries with the shard of their own cell that lies nearest to their distance."""
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        order = np.lexsort((c.low, c.cell))
        own, low, shard = c.cell[order], c.low[order], c.shard[order]
        firsts = np.searchsorted(own, np.arange(len(c.pivots)))
        for batch in batches:
            cell, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ends = np.searchsorted(own, cell, side="right")
            spots = [max(firsts[i], firsts[i] + np.searchsorted(low[firsts[i] : e], x, side="right") - 1) for i, e, x in zip(cell, ends, d, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard[spots], pa.int32())], names=[*batch.schema.names, "shard"])

    return queries.mapInArrow(run, "id bigint, v array<double>, cell int, d double, shard int")


def _other_shards(first: DataFrame, cells: _Cells, k: int) -> DataFrame:
    """Queries with their bound, once for each further shard that may hold a nearer row."""
    sent = first.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in (b.slice(a, 1024) for b in batches for a in range(0, b.num_rows, 1024)):
            d, own, bounds = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            far = c.distances(_matrix(batch.column(1)), cells=batch.column(2).to_numpy())
            spots, shards = [], []
            for i in range(len(d)):
                near = (c.least(far[i], d[i], c.cell, c.low, c.high) <= bounds[i]) & (far[i][c.cell] < FAR)
                more = np.unique(c.shard[near])
                more = more[more != own[i]]
                spots.append(np.full(len(more), i))
                shards.append(more)
            spots = pa.array(np.concatenate(spots), pa.int64())
            taken = [column.take(spots) for column in batch.columns]
            yield pa.RecordBatch.from_arrays([*taken[:4], pa.array(np.concatenate(shards), pa.int32()), taken[5]], names=["id", "v", "cell", "d", "shard", "bound"])

    bound = F.coalesce(F.get("distances", F.lit(k - 1)), F.lit(float("inf")))
    return first.select("id", "v", "cell", "d", "shard", bound.alias("bound")).mapInArrow(
        run, "id bigint, v array<double>, cell int, d double, shard int, bound double")


def nearest_rows(rows: DataFrame, queries: DataFrame, row_id: str, features: Sequence[str] | str, k: int, skip_self: bool = True,
                 group: str | None = None, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS, counted: bool = False) -> DataFrame:
    """query_id, rank (from 1), id, distance; ties go to the smaller id.

    ``features`` are numeric columns or one array column; rows and queries with
    a null, NaN or infinite feature take no part.  With ``group`` only rows of
    the query's group are its neighbours (a null group takes no part).  Ids are
    distinct.  With ``counted`` the column ``compared`` says how many rows the
    query was compared with, in the row of its first neighbour.
    """
    left, right, spark = _vectors(rows, row_id, features, group), _vectors(queries, row_id, features, group), rows.sparkSession
    want = k + skip_self
    n = left.count()
    share = Window.partitionBy("g").orderBy(F.xxhash64("id", F.lit(1)), "id")
    most = min(pivots, max(1, round(n**0.5)))
    taken = left.withColumn("_n", F.row_number().over(share)).filter(F.col("_n") <= most).select("g", "v").collect() if n else []
    if not taken:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, distance double" + ", compared bigint" * counted)
    chosen = sorted({(r[0], tuple(r[1])) for r in taken})
    cells = _Cells(np.array([c[1] for c in chosen], float).reshape(len(chosen), -1), np.array([c[0] for c in chosen], object))

    copies = Window.partitionBy("cell", "v").orderBy("id")
    kept = _assigned(left, cells).withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= want).drop("_n")
    ranges = min(MAX_SHARDS, -(-n // shard_rows))
    dealt = kept.repartitionByRange(ranges, "cell", "d", F.xxhash64("v")).withColumn("shard", F.spark_partition_id())
    shards = durable(dealt)
    pieces = shards.groupBy("shard", "cell").agg(F.min("d"), F.max("d")).collect()  # a row a shard, and one a pivot more at most
    columns = [np.array(c) for c in zip(*pieces, strict=True)]
    cells = _Cells(cells.pivots, cells.groups, *columns)

    first = durable(_visit(shards, _own_shard(_assigned(right, cells), cells).withColumn("bound", F.lit(float("inf"))), cells, want, True))
    found = first
    if ranges > 1:
        found = first.unionByName(_visit(shards, _other_shards(first, cells, want), cells, want, False))
    found = found.select("id", "compared", F.arrays_zip("ids", "distances").alias("near"))
    if counted:
        found = durable(found)
    near = found.select(F.col("id").alias("query_id"), F.explode("near").alias("n")).select("query_id", F.col("n.ids").alias("id"), F.col("n.distances").alias("distance"))
    if skip_self:
        near = near.filter("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    out = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
    if not counted:
        return out
    sums = found.groupBy(F.col("id").alias("query_id")).agg(F.sum("compared").alias("compared"))
    return out.join(sums, "query_id").withColumn("compared", F.when(F.col("rank") == 1, F.col("compared")))
