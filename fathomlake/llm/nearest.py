"""Approximate nearest neighbours by collision-counting hashing.

A hash is a single random projection.  An index of a shard of vectors is, for
each of ``projections`` lines, the projected values in sorted order.  A query
opens a window centred on its own projected value on every line and counts, for
each vector, the lines on which it falls inside.  Vectors that reach the
collision threshold are verified by their true distance.  If the k-th best
distance exceeds the window's half-width, all windows are widened by the factor
``growth`` (virtual rehashing: the same sorted arrays, read further) and only
the newly covered stretches are counted.

A vector at distance r lies in a window of half-width r with probability 0.68 on
each line, so at the end, all vectors nearer than the k-th found have expected
counts of at least ``0.68 * projections`` against a threshold of
``collisions * projections``: that bounds the misses.

Every valid row is indexed.  Rows are dealt to the cell of their nearest pivot;
the pivots are a sample of at most ``max_cells`` vectors, about one for
``shard_rows`` rows.  A cell with more rows is cut into shards by a hash of the id.  A
query first visits its own cell.  The k-th distance found there bounds how far
better neighbours can lie, so by the triangle inequality only cells with
``distance to the pivot - radius of the cell`` below it can hold one: those are
visited next, with windows that begin at that bound, and no other.  That
pruning loses nothing; how much it saves depends on how clustered the vectors
are.  A task gets one shard and about ``block_rows`` of the queries that visit
it.  The k best of all visits are kept.

Null vectors, zero vectors and those that hold null or non-finite components
take no part; vectors of other dimensions are not candidates.  Ties go to the
smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SEED = 20240601
RESULT = "query_id bigint, vec_id bigint, score double"


def valid(vector: Column) -> Column:
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(numbers, lambda x: x != 0), F.lit(False))


class SortedLines:
    """The index of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int):
        self.ids, self.vectors = ids, vectors
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], projections))
        projected = (vectors @ self.lines).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(projected, self.order, axis=1)

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the windows of all queries (rows) on all lines (columns)."""
        low = np.stack([v.searchsorted(x - half) for v, x in zip(self.values, at.T, strict=True)], axis=1)
        high = np.stack([v.searchsorted(x + half, side="right") for v, x in zip(self.values, at.T, strict=True)], axis=1)
        return low, high

    def first_halves(self, at: np.ndarray, few: int) -> np.ndarray:
        """Half-widths that hold about ``few`` rows: the median over the lines."""
        last, side = len(self.ids) - 1, few // 2
        spread = []
        for v, x in zip(self.values, at.T, strict=True):
            spot = v.searchsorted(x)
            spread.append(v[np.minimum(last, spot + side)] - v[np.maximum(0, spot - side)])
        return np.median(np.stack(spread), axis=0) / 2

    def search(self, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, collisions: float, growth: float) -> Iterator[tuple[int, int, float]]:
        """(query, candidate, distance) of each query's k best; none beyond its bound is of use."""
        n = len(self.ids)
        need = math.ceil(collisions * len(self.values))
        at = queries @ self.lines
        halves = np.maximum(np.where(np.isfinite(bounds), bounds, self.first_halves(at, min(n - 1, 4 * k))), 1e-12)
        lows, highs = self.windows(at, halves)
        for q, query, bound, x, half, low, high in zip(ids, queries, bounds, at, halves, lows, highs, strict=True):
            counts = np.zeros(n, np.int32)
            checked = self.ids == q
            found_d, found_i = np.empty(0), np.empty(0, np.int64)
            fresh = [o[a:b] for o, a, b in zip(self.order, low, high, strict=True)]
            while True:
                counts += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
                new = np.flatnonzero((counts >= need) & ~checked)
                if len(new):
                    checked[new] = True
                    gap = self.vectors[new] - query
                    found_d = np.concatenate([found_d, np.sqrt((gap * gap).sum(axis=1))])
                    found_i = np.concatenate([found_i, self.ids[new]])
                    best = np.lexsort((found_i, found_d))[:k]
                    found_d, found_i = found_d[best], found_i[best]
                if half >= bound or (len(found_d) == k and found_d[-1] <= half) or (low.max() == 0 and high.min() == n):
                    break
                half *= growth
                wider_low, wider_high = (w[0] for w in self.windows(x[None, :], np.array([half])))
                fresh = [o[a:b] for o, a, b in zip(self.order, wider_low, low, strict=True)]
                fresh += [o[a:b] for o, a, b in zip(self.order, high, wider_high, strict=True)]
                low, high = wider_low, wider_high
            yield from ((int(q), i, d) for d, i in zip(found_d.tolist(), found_i.tolist(), strict=True))


class Pivots:
    """The cells' centres; a vector whose dimension no pivot has is in cell -1."""

    def __init__(self, vectors: list[list[float]]):
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in sorted({len(v) for v in vectors}):
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            self.groups[dim] = (np.array(at), np.array([vectors[i] for i in at], np.float64))

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and rows x cells distances, for rows of one dimension."""
        cells, centres = self.groups.get(rows.shape[1], (np.array([-1]), np.zeros((1, rows.shape[1]))))
        square = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T
        return cells, np.sqrt(np.maximum(square, 0.0))


def _by_dim(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, part in frame.groupby("dim"):
        yield part, np.stack(part["v"].to_numpy()).astype(np.float64)


def _assigned(df: DataFrame, pivots: Pivots) -> DataFrame:
    """``df`` with the cell of each vector and its distance to the pivot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, rows in _by_dim(frame):
                cells, far = pivots.distances(rows)
                at = far.argmin(axis=1)
                yield part.assign(cell=cells[at].astype(np.int32), far=far[np.arange(len(at)), at])

    return df.mapInPandas(run, "id bigint, v array<double>, dim int, cell int, far double")


def _visits(asked: DataFrame, pivots: Pivots, radius: dict[tuple[int, int], float]) -> DataFrame:
    """``asked`` (with own cell and bound), a row for every other cell that may hold a better one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, rows in _by_dim(frame):
                dim = rows.shape[1]
                cells, far = pivots.distances(rows)
                wide = np.array([radius.get((dim, int(c)), -np.inf) for c in cells])
                near = far - wide[None, :] <= part["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9
                near &= cells[None, :] != part["cell"].to_numpy()[:, None]
                i, j = np.nonzero(near)
                for at in range(0, len(i), 10_000):
                    some = part.iloc[i[at : at + 10_000]]
                    yield some.assign(cell=cells[j[at : at + 10_000]].astype(np.int32))

    return asked.mapInPandas(run, "id bigint, v array<double>, dim int, cell int, bound double")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    projections: int = 64,
    collisions: float = 0.55,
    growth: float = 1.3,
    shard_rows: int = 8192,
    block_rows: int = 4096,
    max_cells: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance)."""

    def usable(df: DataFrame) -> DataFrame:
        numbers = F.transform(vector_col, lambda x: x.cast("double"))
        return df.filter(valid(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), numbers.alias("v"), F.size(vector_col).alias("dim"))

    own = usable(vectors)
    cells = min(max_cells, max(1, -(-own.count() // shard_rows)))
    pivots = Pivots([list(r["v"]) for r in own.orderBy(F.xxhash64("id", F.lit(SEED)), "id").select("v").limit(cells).collect()])
    placed = durable(_assigned(own, pivots))
    sizes = {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in placed.groupBy("dim", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}  # a row a cell
    shards = {key: -(-n // shard_rows) for key, (n, _) in sizes.items()}

    def parts(held: dict[tuple[int, int], int]) -> Column:
        found = F.create_map(*[x for (dim, cell), n in held.items() for x in (F.lit(f"{dim}:{cell}"), F.lit(n))]) if held else None
        name = F.concat_ws(":", F.col("dim").cast("string"), F.col("cell").cast("string"))
        return F.coalesce(F.try_element_at(found, name), F.lit(1)) if held else F.lit(1)

    def dealt(n: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    def answer(rows: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(questions):
            index = SortedLines(rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.float64), projections)
            asked = np.stack(questions["v"].to_numpy()).astype(np.float64)
            out = list(index.search(questions["id"].to_numpy(np.int64), asked, questions["bound"].to_numpy(np.float64), k, collisions, growth))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def visit(asked: DataFrame) -> DataFrame:
        """What the queries find in the cells that they name."""
        many = {(r["dim"], r["cell"]): -(-r["count"] // block_rows) for r in asked.groupBy("dim", "cell").count().collect()}
        blocks = parts(many)
        left = placed.select("id", "v", "dim", "cell", dealt(parts(shards), 1).alias("shard"), every(blocks).alias("block"))
        right = asked.select("id", "v", "dim", "cell", "bound", every(parts(shards)).alias("shard"), dealt(blocks, 2).alias("block"))
        keys = ["dim", "cell", "shard", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(answer, RESULT)

    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)

    asked = durable(_assigned(usable(queries), pivots).withColumn("bound", F.lit(float("inf"))).drop("far"))
    first = durable(best(visit(asked)))
    last = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    bounded = asked.join(last, "id", "left").select("id", "v", "dim", "cell", F.coalesce("kth", "bound").alias("bound"))
    second = visit(durable(_visits(bounded, pivots, {key: r for key, (_, r) in sizes.items()})))
    return best(first.drop("rank").unionByName(second)).select("query_id", "rank", "vec_id", "score")
