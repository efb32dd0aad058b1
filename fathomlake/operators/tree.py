"""Decision trees grown a level at a time, and forests whose trees share levels.

A level is one plan over all open nodes of all trees: features are unpivoted,
rows counted by (tree, node, feature, value, class), counts cumulated over the
values, and the split with the largest information gain kept; thresholds are
values that occur, and ``<=`` goes left.  The first feature and the smallest
value win ties.  Only the node table, with a row a node, reaches the driver.

Values lie in ranges of (tree, node, feature, value), one a partition, so no task
holds all values of a feature.  The class counts of the ranges give the exact
gain at their ends, and a bound on the gain inside: the gain is convex in the
class counts on the left, so it is largest at a corner of the counts before and
after the range.  Only ranges whose bound reaches the best end are scanned.

A bootstrap draws n of n rows for each tree.  The draws are dealt to buckets of
the row's hash by a seeded multinomial and within a bucket to its rows in the
order of their hash, so weights sum to n and do not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.expr import md5_key
from ..functions.spread import total_parts
from .metrics import labels_of

EPSILON = 1e-15
#: Classes of which every corner of a range is tried; with more, every range is scanned.
CORNER_CLASSES = 6
#: Rows of a bootstrap bucket, unless that makes more buckets than the driver is to hold.
BUCKET_ROWS = 4096
MAX_BUCKETS = 1 << 16
NODES = ("tree int, node long, parent long, feature int, threshold double, is_leaf boolean, label {label}, n double, entropy double, gain double")


def entropy_of(counts: Sequence[float]) -> float:
    total = sum(counts)
    return -sum(c / total * math.log2(c / total + EPSILON) for c in counts if c) if total else 0.0


def _entropy(counts: Sequence[Column]) -> Column:
    total = sum(counts[1:], counts[0])
    parts = [F.coalesce(F.try_divide(c, total), F.lit(0.0)) for c in counts]
    return -sum(((p * F.log2(p + EPSILON)) for p in parts[1:]), parts[0] * F.log2(parts[0] + EPSILON))


def best_splits(rows: DataFrame, features: Sequence[str], classes: Sequence, keys: Sequence[str] = ("tree", "node"), allowed: DataFrame | None = None) -> DataFrame:
    """keys, feature, threshold, gain of the best split of each node.

    ``rows`` has the keys, the features, _y and _w (a weight); ``allowed``
    limits (tree, feature).
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])).alias("c")
    tall = rows.select(*keys, "_y", "_w", cells).select(*keys, "_y", "_w", "c.*")
    if allowed is not None:
        tall = tall.join(F.broadcast(allowed), ["tree", "feature"], "left_semi")  # a row a tree and feature
    some = range(len(classes))
    counts = tall.groupBy(*keys, "feature", "value").agg(*[F.sum(F.when(F.col("_y") == F.lit(c), F.col("_w")).otherwise(0.0)).alias(f"n{k}") for k, c in enumerate(classes)])
    counts = durable(counts.repartitionByRange(total_parts(rows), *keys, "feature", "value").withColumn("_part", F.spark_partition_id()))

    def gain(left: Sequence[Column], total: Sequence[Column]) -> Column:
        right = [t - a for a, t in zip(left, total, strict=True)]
        n_left, n_right, n = sum(left[1:], left[0]), sum(right[1:], right[0]), sum(total[1:], total[0])
        return F.when((n_left > 0) & (n_right > 0), _entropy(total) - n_left / n * _entropy(left) - n_right / n * _entropy(right)).otherwise(0.0)

    # a row a range: of each node and feature at most one a partition
    of = [*keys, "feature"]
    before = Window.partitionBy(*of).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*of, "_part").agg(*[F.sum(f"n{k}").alias(f"r{k}") for k in some])
    ranges = ranges.select(*of, "_part", *[F.coalesce(F.sum(f"r{k}").over(before), F.lit(0.0)).alias(f"b{k}") for k in some],
                           *[F.sum(f"r{k}").over(Window.partitionBy(*of)).alias(f"t{k}") for k in some], *[f"r{k}" for k in some])
    total = [F.col(f"t{k}") for k in some]
    ends = [F.col(f"b{k}") + F.col(f"r{k}") for k in some]
    if len(classes) <= CORNER_CLASSES:
        corners = [gain([ends[k] if high else F.col(f"b{k}") for k, high in enumerate(corner)], total) for corner in product((False, True), repeat=len(classes))]
        bound = F.greatest(*corners) if len(corners) > 1 else corners[0]
    else:
        bound = F.lit(float("inf"))
    judged = ranges.withColumn("_end", gain(ends, total)).withColumn("_bound", bound)
    promising = judged.withColumn("_best", F.max("_end").over(Window.partitionBy(*keys))).filter(F.col("_bound") >= F.col("_best") - 1e-9)
    promising = promising.select(*of, "_part", *[f"b{k}" for k in some], *[f"t{k}" for k in some])

    up_to = Window.partitionBy(*of, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = counts.join(promising, [*of, "_part"]).select(*of, "value", *[(F.col(f"b{k}") + F.sum(f"n{k}").over(up_to)).alias(f"l{k}") for k in some], *[f"t{k}" for k in some])
    scored = wide.select(*of, F.col("value").alias("threshold"), F.round(gain([F.col(f"l{k}") for k in some], total), 12).alias("gain"))
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "threshold")).alias("_s"))
    return best.select(*keys, "_s.feature", "_s.threshold", (-F.col("_s.loss")).alias("gain"))


@dataclass(frozen=True)
class Forest:
    """Trees as one node table (rows as in ``NODES``)."""

    features: tuple[str, ...]
    classes: tuple
    nodes: tuple[tuple, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        kind = "string" if isinstance(self.classes[0], str) else "double" if isinstance(self.classes[0], float) else "int"
        return spark.createDataFrame(list(self.nodes), NODES.format(label=kind))

    def _tree(self, tree: int) -> Column:
        own = {n[1]: n for n in self.nodes if n[0] == tree}

        def at(node: int) -> Column:
            _, _, _, feature, threshold, leaf, label, *_ = own[node]
            if leaf:
                return F.lit(label)
            return F.when(F.col(self.features[feature]) <= threshold, at(2 * node)).otherwise(at(2 * node + 1))

        return at(1)

    @property
    def trees(self) -> list[int]:
        return sorted({n[0] for n in self.nodes})

    def probabilities(self) -> Column:
        """Vote shares in the order of the classes."""
        votes = F.array(*[self._tree(t) for t in self.trees])
        return F.transform(F.array(*[F.lit(c) for c in self.classes]),
                           lambda c: F.size(F.filter(votes, lambda v: v == c)) / float(len(self.trees)))

    def predict(self) -> Column:
        """The class with most votes, the smallest of equals."""
        shares = self.probabilities()
        return F.array(*[F.lit(c) for c in self.classes])[(F.array_position(shares, F.array_max(shares)) - 1).cast("int")]

    def importances(self) -> dict[str, float]:
        """Gain times rows, normalised in each tree, averaged over the trees."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            own = dict.fromkeys(self.features, 0.0)
            for n in self.nodes:
                if n[0] == t and not n[5]:
                    own[self.features[n[3]]] += n[9] * n[7]
            whole = sum(own.values())
            for f, v in own.items():
                total[f] += v / whole / len(self.trees) if whole else 0.0
        return total


def _grow(rows: DataFrame, features: Sequence[str], max_depth: int, min_split: int, allowed: DataFrame | None) -> Forest:
    """``rows``: tree, features, _y, _w."""
    classes = labels_of(rows, "_y", "_y")
    data = rows.withColumn("node", F.lit(1).cast("long")).cache()
    nodes: list[tuple] = []
    try:
        placed = data
        for depth in range(max_depth + 1):
            sums = placed.groupBy("tree", "node").agg(*[F.sum(F.when(F.col("_y") == F.lit(c), F.col("_w")).otherwise(0.0)).alias(f"n{k}") for k, c in enumerate(classes)])
            counts = {(r["tree"], r["node"]): [r[f"n{k}"] for k in range(len(classes))] for r in sums.collect()}
            open_nodes = [key for key, c in counts.items() if depth < max_depth and sum(c) >= min_split and sum(x > 0 for x in c) > 1]
            found = {}
            if open_nodes:
                wanted = rows.sparkSession.createDataFrame(open_nodes, "tree int, node long")
                splits = best_splits(placed.join(F.broadcast(wanted), ["tree", "node"], "left_semi"), features, classes, allowed=allowed)
                found = {(r["tree"], r["node"]): r for r in splits.filter("gain > 0").collect()}
            for (tree, node), c in sorted(counts.items()):
                s = found.get((tree, node))
                label = classes[max(range(len(c)), key=lambda i: (c[i], -i))]
                nodes.append((tree, node, node // 2 or None, s["feature"] if s else None, s["threshold"] if s else None, s is None, label, float(sum(c)), entropy_of(c), float(s["gain"]) if s else 0.0))
            if not found:
                break
            step = rows.sparkSession.createDataFrame([(t, n, s["feature"], s["threshold"]) for (t, n), s in found.items()], "tree int, node long, feature int, threshold double")
            value = F.array(*[F.col(c).cast("double") for c in features])[F.col("feature")]
            placed = placed.join(F.broadcast(step), ["tree", "node"]).withColumn(
                "node", F.col("node") * 2 + (value > F.col("threshold")).cast("long")).drop("feature", "threshold")
        return Forest(tuple(features), tuple(classes), tuple(nodes))
    finally:
        data.unpersist()


def fit_tree(df: DataFrame, features: Sequence[str], y: str, max_depth: int = 5, min_split: int = 2) -> Forest:
    rows = df.select(F.lit(0).alias("tree"), *features, F.col(y).alias("_y"), F.lit(1.0).alias("_w"))
    return _grow(rows, features, max_depth, min_split, None)


def feature_subset(features: Sequence[str], trees: int, share: float | int | str | None, seed: str) -> list[tuple[int, int]]:
    """(tree, feature): a fixed number of features drawn once a tree."""
    import hashlib

    d = len(features)
    size = int(math.sqrt(d)) if share in (None, "sqrt") else int(share * d) if isinstance(share, float) else int(share)
    out = []
    for t in range(trees):
        order = sorted(range(d), key=lambda i: hashlib.md5(f"{t}-{i}-{seed}".encode()).hexdigest())
        out += [(t, i) for i in sorted(order[: max(1, size)])]
    return out


def bootstrap(df: DataFrame, row_id: str, trees: int, seed: str = "42", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_ws``: how often each tree draws the row, n draws a tree; rows that no tree draws stay.

    The order of rows with one id is that of their other columns.
    """
    n = df.count()
    bits = min(MAX_BUCKETS.bit_length() - 1, max(0, (n // bucket_rows).bit_length()))
    key = md5_key([row_id], seed)
    bucket = F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits)
    keyed = df.withColumn("_bucket", bucket).withColumn("_key", key)
    sizes = dict(keyed.groupBy("_bucket").count().collect()) if n else {}  # at most MAX_BUCKETS rows
    buckets = sorted(sizes)
    shares = np.array([sizes[b] for b in buckets], float) / max(n, 1)
    base = int.from_bytes(seed.encode(), "little")
    draws = {}
    for tree in range(trees if n else 0):
        dealt = np.random.default_rng([base, tree]).multinomial(n, shares)
        for b, k in zip(buckets, dealt, strict=True):
            draws.setdefault(b, []).append(int(k))
    sent = df.sparkSession.sparkContext.broadcast(draws)
    order = ["_key", *df.columns]

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        b, m = int(rows["_bucket"].iloc[0]), len(rows)
        drawn = [np.bincount(np.random.default_rng([base, tree, b]).integers(0, m, k), minlength=m) for tree, k in enumerate(sent.value[b])]
        rows["_ws"] = list(np.stack(drawn, axis=1).astype(np.int64))
        return rows.drop(columns=["_bucket", "_key"])

    schema = df.withColumn("_ws", F.array(F.lit(0).cast("long"))).schema
    return keyed.groupBy("_bucket").applyInPandas(inside, schema)


def fit_forest(df: DataFrame, features: Sequence[str], y: str, row_id: str, trees: int = 10, max_depth: int = 5, min_split: int = 2,
               feature_share: float | int | str | None = "sqrt", seed: str = "42") -> Forest:
    """Trees on bootstraps of n draws each, all grown together."""
    plain = df.select(F.col(row_id), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(y).alias("_y"))
    drawn = bootstrap(plain, row_id, trees, seed).select(*[F.col(f"f{i}").alias(c) for i, c in enumerate(features)], "_y", F.posexplode("_ws").alias("tree", "_n"))
    rows = drawn.filter("_n > 0").withColumn("_w", F.col("_n").cast("double")).select("tree", *features, "_y", "_w")
    allowed = df.sparkSession.createDataFrame(feature_subset(features, trees, feature_share, seed), "tree int, feature int")
    return _grow(rows, features, max_depth, min_split, allowed)
