"""K-means by Lloyd's rounds.

Centres go out as literals, sums come back: a round is one aggregate over the
cached vectors, whatever the number of models fitted side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import argmin, distance, lit_vector, md5_key


@dataclass(frozen=True)
class KMeansModel:
    centres: np.ndarray

    def distances(self, vector: str) -> Column:
        return F.array(*[distance(vector, lit_vector(c)) for c in self.centres])

    def predict(self, vector: str) -> Column:
        """The nearest centre from 0; the lowest of equals."""
        return argmin(self.distances(vector))

    def loss(self, df: DataFrame, vector: str) -> float:
        """Sum of the (unsquared) distances to the nearest centre."""
        return df.agg(F.sum(F.array_min(self.distances(vector)))).first()[0] or 0.0


def _points(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.transform(vector, lambda x: x.cast("double")).alias("_v"))


def initial_rows(df: DataFrame, row_id: str, vector: str, k: int, seed: str = "42") -> np.ndarray:
    """k rows by the md5 order of their ids."""
    rows = df.select(F.col(vector).alias("v"), md5_key([row_id], seed).alias("key"), F.col(row_id).alias("id")).orderBy("key", "id").limit(k).collect()
    return np.array([r["v"] for r in rows], float)


def fit_many(df: DataFrame, vector: str, starts: Sequence[np.ndarray], max_rounds: int = 300, tolerance: float = 1e-4) -> list[KMeansModel]:
    """One model for each start; all open models share each pass.

    An empty cluster keeps its centre.  When the shift of all centres (Frobenius
    norm) falls below the tolerance, the centres before that shift are kept.
    """
    points = _points(df, vector).cache()
    centres, done = [np.array(s, float) for s in starts], [False] * len(starts)
    try:
        for _ in range(max_rounds):
            active = [i for i, d in enumerate(done) if not d]
            if not active:
                break
            width = centres[active[0]].shape[1]
            chosen = F.array(*[F.struct(F.lit(i).alias("model"), KMeansModel(centres[i]).predict("_v").alias("cluster")) for i in active])
            rows = points.select("_v", F.explode(chosen).alias("c")).groupBy("c.model", "c.cluster").agg(
                F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_v")[j]).alias(f"s{j}") for j in range(width)]).collect()
            new = {i: centres[i].copy() for i in active}
            for r in rows:
                new[r["model"]][r["cluster"]] = [r[f"s{j}"] / r["n"] for j in range(width)]
            for i in active:
                if np.linalg.norm(new[i] - centres[i]) < tolerance:
                    done[i] = True
                else:
                    centres[i] = new[i]
        return [KMeansModel(c) for c in centres]
    finally:
        points.unpersist()


def fit(df: DataFrame, row_id: str, vector: str, k: int = 8, max_rounds: int = 300, tolerance: float = 1e-4, seed: str = "42") -> KMeansModel:
    return fit_many(df, vector, [initial_rows(df, row_id, vector, k, seed)], max_rounds, tolerance)[0]


def elbow(df: DataFrame, row_id: str, vector: str, ks: Sequence[int], max_rounds: int = 300, seed: str = "42") -> list[tuple[int, float]]:
    """(k, loss) for each k; all fits share their passes."""
    starts = [initial_rows(df, row_id, vector, k, seed) for k in ks]
    models = fit_many(df, vector, starts, max_rounds)
    points = df.select(*[F.array_min(m.distances(vector)).alias(f"d{i}") for i, m in enumerate(models)])
    row = points.agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(len(models))]).first()
    return [(k, row[f"d{i}"]) for i, k in enumerate(ks)]


def best_seed(df: DataFrame, row_id: str, vector: str, k: int, seeds: Sequence[str], max_rounds: int = 300) -> list[tuple[str, float]]:
    """(seed, loss) for each seed; the first smallest is the best."""
    models = fit_many(df, vector, [initial_rows(df, row_id, vector, k, s) for s in seeds], max_rounds)
    row = df.agg(*[F.sum(F.array_min(m.distances(vector))).alias(f"d{i}") for i, m in enumerate(models)]).first()
    return [(s, row[f"d{i}"]) for i, s in enumerate(seeds)]


def fit_until_labels_settle(df: DataFrame, row_id: str, vector: str, k: int, max_rounds: int = 100, seed: str = "42") -> KMeansModel:
    """The older rule: stop when no label changes; an empty cluster takes a row."""
    points = df.select(F.col(row_id).alias("_id"), F.transform(vector, lambda x: x.cast("double")).alias("_v")).cache()
    model, last, spare = KMeansModel(initial_rows(df, row_id, vector, k, seed)), None, initial_rows(df, row_id, vector, 2 * k, seed)
    try:
        for _ in range(max_rounds):
            placed = points.withColumn("_c", model.predict("_v"))
            mark = placed.agg(F.sum(F.xxhash64("_id", "_c").cast("decimal(38,0)"))).first()[0]
            if mark == last:
                break
            last = mark
            width = model.centres.shape[1]
            sums = {r["_c"]: r for r in placed.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_v")[j]).alias(f"s{j}") for j in range(width)]).collect()}
            model = KMeansModel(np.array([[sums[c][f"s{j}"] / sums[c]["n"] for j in range(width)] if c in sums else spare[(k + c) % len(spare)] for c in range(k)]))
        return model
    finally:
        points.unpersist()
