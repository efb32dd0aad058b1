"""Splits, bootstraps and forests against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.functions.durable import durable
from fathomlake.operators import tree


def entropy(counts) -> float:
    total = sum(counts)
    return -sum(c / total * math.log2(c / total + tree.EPSILON) for c in counts)


def plain_split(rows, classes):
    """(feature, threshold, gain) of rows (values, label, weight)."""
    whole = [sum(w for _, y, w in rows if y == c) for c in classes]
    best = (0.0, None, None)
    for feature in range(len(rows[0][0])):
        for value in sorted({x[feature] for x, _, _ in rows}):
            left = [sum(w for x, y, w in rows if y == c and x[feature] <= value) for c in classes]
            right = [t - a for t, a in zip(whole, left, strict=True)]
            if sum(left) > 0 and sum(right) > 0:
                n = sum(whole)
                gain = round(entropy(whole) - sum(left) / n * entropy(left) - sum(right) / n * entropy(right), 12)
                if gain > best[0]:
                    best = (gain, feature, value)
    return best[1], best[2], best[0]


def plain_tree(rows, classes, depth, min_split, allowed):
    counts = [sum(w for _, y, w in rows if y == c) for c in classes]
    label = classes[max(range(len(classes)), key=lambda i: (counts[i], -i))]
    if depth == 0 or sum(counts) < min_split or sum(c > 0 for c in counts) < 2:
        return label
    masked = [([x[i] if i in allowed else 0.0 for i in range(len(x))], y, w) for x, y, w in rows]
    feature, value, gain = plain_split(masked, classes)
    if not gain or gain <= 0:
        return label
    sides = [[r for r in rows if (r[0][feature] <= value) == left] for left in (True, False)]
    return feature, value, *[plain_tree(s, classes, depth - 1, min_split, allowed) for s in sides]


def vote(node, x):
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def random_rows(n, seed, classes):
    draw = random.Random(seed)
    return [(i, float(draw.randrange(12)), round(draw.gauss(0, 1), 2), draw.choice(classes)) for i in range(n)]


@pytest.mark.parametrize("classes", [[0, 1], ["a", "b", "c"], list(range(8))])
def test_the_best_split_equals_a_plain_scan(spark, classes):
    kind = "string" if isinstance(classes[0], str) else "int"
    rows = random_rows(300, len(classes), classes)
    df = spark.createDataFrame(rows, f"id long, f0 double, f1 double, _y {kind}").selectExpr("0 as tree", "id % 3 as node", "f0", "f1", "_y", "double(1 + id % 2) as _w")
    got = {r["node"]: (r["feature"], r["threshold"], r["gain"]) for r in tree.best_splits(df, ["f0", "f1"], classes).collect()}
    for node in range(3):
        feature, value, gain = plain_split([((a, b), y, 1 + i % 2) for i, a, b, y in rows if i % 3 == node], classes)
        assert got[node][:2] == (feature, value)
        assert got[node][2] == pytest.approx(gain, abs=1e-11)


def test_a_feature_with_a_million_values_is_split_in_ranges(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.lit(0).alias("tree"), F.lit(1).alias("node"), F.xxhash64("id").cast("double").alias("f0"),
                                                F.lit(1.0).alias("_w"), (F.xxhash64("id") > F.lit(2**61)).cast("int").alias("flip"), "id")
    df = df.withColumn("_y", F.when(F.col("id") % 10 == 0, 1 - F.col("flip")).otherwise(F.col("flip")))
    (got,) = tree.best_splits(df, ["f0"], [0, 1]).collect()
    x, y = (np.array(c) for c in zip(*df.select("f0", "_y").toPandas().itertuples(index=False), strict=True))
    order = np.argsort(x, kind="stable")
    x, ones = x[order], np.cumsum(y[order])
    last = np.flatnonzero(np.append(np.diff(x) > 0, True))
    left, one = last + 1.0, ones[last].astype(float)

    def h(a, m):
        p = np.divide(a, m, out=np.zeros_like(a), where=m > 0)
        return -(p * np.log2(p + tree.EPSILON) + (1 - p) * np.log2(1 - p + tree.EPSILON))

    gain = h(np.array([one[-1]]), np.array([float(n)])) - left / n * h(one, left) - (n - left) / n * h(one[-1] - one, n - left)
    gain[-1] = 0
    assert got["threshold"] == x[last][np.round(gain, 12).argmax()]
    counts = durable(df.groupBy("f0").count().repartitionByRange(4, "f0").withColumn("p", F.spark_partition_id()))
    assert counts.groupBy("p").count().agg(F.max("count")).first()[0] < 2 * n / 4


def test_a_bootstrap_draws_n_rows_whatever_the_partitioning(spark):
    df = spark.createDataFrame([(i, i * 0.5) for i in range(900)], "id long, x double")
    drawn = [{r["id"]: r["_ws"] for r in tree.bootstrap(df.repartition(p), "id", 6, bucket_rows=100).collect()} for p in (1, 7)]
    assert drawn[0] == drawn[1]
    weights = np.array(list(drawn[0].values()))
    assert weights.shape == (900, 6)
    assert (weights.sum(axis=0) == 900).all()
    assert 0.3 < (weights == 0).mean() < 0.43  # 1 / e
    assert weights.max() > 3
    whole = {r["id"]: r["_ws"] for r in tree.bootstrap(df, "id", 6, seed="7", bucket_rows=100).collect()}
    assert whole != drawn[0]
    assert tree.bootstrap(df.limit(0), "id", 2).collect() == []
    repeated = spark.createDataFrame([(1, 0.5)] * 50 + [(None, 1.0)] * 50, "id long, x double")
    assert sum(r["_ws"][0] for r in tree.bootstrap(repeated, "id", 1).collect()) == 100


def test_forest_votes_equal_plain_trees_on_the_same_draws(spark):
    rows = [(i, a, b, int(a + 3 * b + i % 3 > 6)) for i, a, b, _ in random_rows(240, 5, [0])]
    df = spark.createDataFrame(rows, "id long, f0 double, f1 double, y int")
    forest = tree.fit_forest(df, ["f0", "f1"], "y", "id", 4, 3, feature_share=1)
    plain = df.select("id", "f0", "f1", F.col("y").alias("_y"))
    draws = {r["id"]: r["_ws"] for r in tree.bootstrap(plain, "id", 4).collect()}
    allowed = tree.feature_subset(["f0", "f1"], 4, 1, "42")
    trees = [plain_tree([((a, b), y, float(draws[i][t])) for i, a, b, y in rows if draws[i][t]], [0, 1], 3, 2, [f for k, f in allowed if k == t]) for t in range(4)]
    got = {r["id"]: (r["p"], r["v"]) for r in df.select("id", forest.predict().alias("p"), forest.probabilities()[1].alias("v")).collect()}
    for i, a, b, _ in rows:
        votes = [vote(t, (a, b)) for t in trees]
        assert got[i] == (int(sum(votes) > 2), sum(votes) / 4)
