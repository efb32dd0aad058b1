"""Neighbour searches and radius clusters against plain all-pairs versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.operators import cells, dbscan, features
from fathomlake.operators.knn import nearest_rows


def all_pairs(ids, x, k, skip_self, groups=None):
    out = []
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        near = [j for j in range(len(ids)) if not (skip_self and j == i) and (groups is None or groups[i] is not None and groups[j] == groups[i])]
        near.sort(key=lambda j: (d[j], ids[j]))
        out += [(ids[i], r + 1, ids[j], round(float(d[j]), 9)) for r, j in enumerate(near[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


def frame(spark, ids, x, groups=None):
    rows = [(int(i), [float(a) for a in v], None if groups is None else groups[j]) for j, (i, v) in enumerate(zip(ids, x, strict=True))]
    return spark.createDataFrame(rows, "id long, v array<double>, g string").repartition(3)


def clustered(n=1500, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 10, (15, d))[rng.integers(0, 15, n)] + rng.normal(0, 0.3, (n, d))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    return [int(i) for i in rng.permutation(n)], x


@pytest.mark.parametrize("shard_rows", [16384, 150])
def test_equals_all_pairs_and_compares_few_on_clustered_rows(spark, shard_rows):
    ids, x = clustered()
    df = frame(spark, ids, x)
    near = nearest_rows(df, df, "id", "v", 4, shard_rows=shard_rows, counted=True).cache()
    assert found(near) == all_pairs(ids, x, 4, True)
    assert near.agg(F.sum("compared")).first()[0] < len(ids) ** 2 / 5


def test_equals_all_pairs_where_nothing_can_be_skipped(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 24))
    ids = list(range(300))
    df = frame(spark, ids, x)
    assert found(nearest_rows(df, df, "id", "v", 3, skip_self=False, shard_rows=60)) == all_pairs(ids, x, 3, False)


def test_groups_grids_and_other_queries(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (400, 2)).astype(float)  # many ties
    ids, groups = [int(i) for i in rng.permutation(400)], [None if i % 40 == 0 else str(i % 3) for i in range(400)]
    df = frame(spark, ids, x, groups)
    assert found(nearest_rows(df, df, "id", "v", 5, group="g", shard_rows=50)) == all_pairs(ids, x, 5, True, groups)
    asked = spark.createDataFrame([(-1, [100.0, 0.0], "0"), (-2, [1.0, 1.0], "9"), (-3, [0.5, float("nan")], "0"), (-4, None, "0")], "id long, v array<double>, g string")
    near = nearest_rows(df, asked, "id", "v", 2, group="g", shard_rows=50).collect()
    d = sorted((float(np.hypot(*(v - [100, 0]))), i) for i, v, g in zip(ids, x, groups, strict=True) if g == "0")
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in near) == [(-1, 1, d[0][1]), (-1, 2, d[1][1])]


def test_few_rows_null_features_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 4.0, 6.0), (4, float("inf"), 1.0)], "id long, a double, b double")
    assert found(nearest_rows(df, df, "id", ["a", "b"], 5)) == [(1, 1, 3, 5.0), (3, 1, 1, 5.0)]
    assert found(nearest_rows(df.limit(0), df, "id", ["a", "b"], 5)) == []
    assert found(nearest_rows(df, df.limit(0), "id", ["a", "b"], 5)) == []
    assert "compared" in nearest_rows(df.limit(0), df, "id", ["a", "b"], 5, counted=True).columns


def plain_dbscan(ids, x, eps, least):
    near = [np.flatnonzero(np.sqrt(((x - v) ** 2).sum(axis=1)) <= eps) for v in x]
    core = [len(n) >= least for n in near]
    root = {}
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        if core[i] and i not in root:
            todo = [i]
            root[i] = ids[i]
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and j not in root:
                        root[j] = ids[i]
                        todo.append(j)
    number = {r: k for k, r in enumerate(sorted(set(root.values())))}
    return {ids[i]: number[root[i]] if core[i] else min((number[root[j]] for j in near[i] if core[j]), default=-1) for i in range(len(ids))}


def blobs(n, d, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (n // 4, d)) for c in (0, 2.5, 5)] + [rng.uniform(-1, 6, (n - 3 * (n // 4), d))])
    x[: n // 3] = np.round(x[: n // 3], 1)  # equal points
    return [int(i) for i in rng.permutation(n)], x


@pytest.mark.parametrize(("d", "eps", "least"), [(1, 0.05, 5), (2, 0.4, 40), (4, 0.6, 6)])
def test_clusters_equal_a_plain_dbscan(spark, d, eps, least):
    ids, x = blobs(400, d, d)
    columns = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in zip(ids, x, strict=True)], ", ".join(["id long", *[f"{c} double" for c in columns]]))
    got = {r["id"]: r["cluster"] for r in dbscan.fit_predict(df, "id", columns, eps, least).collect()}
    assert got == plain_dbscan(ids, x, eps, least)


def test_boxes_are_cut_until_they_are_decided(spark, monkeypatch):
    monkeypatch.setattr(cells, "FEW", 2)
    ids, x = blobs(500, 2, 9)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, x, strict=True)], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in dbscan.fit_predict(df, "id", ["x", "y"], 0.5, 150).collect()}
    assert got == plain_dbscan(ids, x, 0.5, 150)
    counts = {r["id"]: r["n_neighbours"] for r in features.radius_neighbour_count(df, "id", ["x", "y"], 0.8).collect()}
    assert counts == {i: int((np.sqrt(((x - v) ** 2).sum(axis=1)) <= 0.8).sum()) - 1 for i, v in zip(ids, x, strict=True)}


def test_a_dense_cell_makes_no_pairs(spark):
    rng = np.random.default_rng(1)
    n = 30_000
    x = np.concatenate([rng.uniform(0, 0.01, (n // 3, 2)), rng.uniform(0, 60, (n - n // 3, 2))])  # a third of all rows in one cell
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    grid = cells.Grid(cells.distinct_points(df, "id", ["x", "y"]), 2, 0.5)
    sent = grid.points.join(grid.pairs, F.col("cell") == F.col("a")).select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("b").alias("cell"))
    assert sent.count() < 21 * n  # what is looked at: a row for each point and cell around it
    got = dbscan.fit_predict(df, "id", ["x", "y"], 0.5, 20).groupBy("cluster").count().collect()
    assert max(r["count"] for r in got if r["cluster"] >= 0) >= n // 3


def test_null_coordinates_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, -0.0, 0.1), (3, 0.1, None), (4, float("nan"), 0.0), (5, 9.0, 9.0), (6, 0.0, 0.0)], "id long, x double, cell double")
    assert {r["id"]: r["cluster"] for r in dbscan.fit_predict(df, "id", ["x", "cell"], 0.5, 3).collect()} == {1: 0, 2: 0, 3: -1, 4: -1, 5: -1, 6: 0}
    assert {r["id"]: r["n"] for r in features.radius_neighbour_count(df, "id", ["x", "cell"], 0.5, "n").collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 2}
    assert dbscan.fit_predict(df.limit(0), "id", ["x", "cell"], 0.5, 3).collect() == []
    with pytest.raises(ValueError, match="radius"):
        dbscan.fit_predict(df, "id", ["x", "cell"], 0.0, 3)


def test_silhouettes_equal_all_pairs_with_copies_and_many_shards(spark, monkeypatch):
    from fathomlake.operators import silhouette

    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 5)) + 1e3
    x[100:160] = x[7]  # copies, some of them in other clusters
    c = draw.integers(-1, 4, 300)
    c[299] = 4  # alone
    df = spark.createDataFrame([(i, [float(a) for a in v], int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id long, v array<double>, k int").repartition(3)
    plain = silhouette._distance_sums
    monkeypatch.setattr(silhouette, "_distance_sums", lambda points: plain(points, 40))
    got = {r["id"]: r for r in silhouette.point_scores(df, "id", "v", "k").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert got.keys() == set(np.flatnonzero(c >= 0).tolist())
    for i, r in got.items():
        a = d[i, c == c[i]].sum() / max((c == c[i]).sum() - 1, 1)
        b = min(d[i, c == k].mean() for k in range(5) if k != c[i])
        assert (r["cluster"], r["a"], r["b"]) == (c[i], pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9))


def test_copies_are_one_point_of_the_silhouette(spark, monkeypatch):
    from fathomlake.operators import silhouette

    df = spark.createDataFrame([(i, [float(i % 20), 1.0], i % 2) for i in range(400)], "id long, v array<double>, k int")
    seen, plain = [], silhouette._distance_sums
    monkeypatch.setattr(silhouette, "_distance_sums", lambda points: seen.append(points.count()) or plain(points))
    assert silhouette.point_scores(df, "id", "v", "k").count() == 400 and seen == [20]


def test_pairs_of_shards_are_many_tasks_and_tiles_of_many_clusters_add_up(spark, monkeypatch):
    from fathomlake.operators import silhouette

    draw = np.random.default_rng(5)
    x, c = draw.normal(size=(700, 5)), draw.integers(0, 300, 700)
    df = spark.createDataFrame([(i, [float(a) for a in v], int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id long, v array<double>, k int")
    plain, plans = silhouette._distance_sums, []
    monkeypatch.setattr(silhouette, "_distance_sums", lambda points: plans.append(plain(points, 300)) or plans[0])
    got = {r["id"]: r for r in silhouette.point_scores(df, "id", "v", "k").collect()}
    # tasks that are small in bytes and long in time are not put together by their bytes
    assert plans[0]._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(0, 700, 7):
        b = min(d[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        assert got[i]["b"] == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("few", [4, 64])
def test_sums_in_the_plane_equal_all_pairs_and_form_few(spark, monkeypatch, few):
    from fathomlake.operators import plane, silhouette

    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(0, 1, (1500, 2)), draw.normal(3, 1e-4, (900, 2)), draw.normal(3, 1e-7, (500, 2)), [[80.0, -60.0]]]) + 100
    c = draw.integers(0, 3, len(x))
    df = spark.createDataFrame([(i, [float(a) for a in v], int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id long, v array<double>, k int").repartition(3)
    df = df.unionByName(df.filter("id < 50").withColumn("id", F.col("id") + 10_000))
    monkeypatch.setattr(silhouette, "FEW_POINTS", 100)
    monkeypatch.setattr(plane, "FEW", few)
    seen, plain = [], plane._pairs
    monkeypatch.setattr(plane, "_pairs", lambda placed: seen.append((placed, *plain(placed))) or seen[0][1:])
    got = {r["id"]: r for r in silhouette.point_scores(df, "id", "v", "k").collect()}
    w = np.ones(len(x))
    w[:50] = 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) * w
    assert len(got) == len(x) + 50
    for i in range(0, len(x), 3):
        a = d[i, c == c[i]].sum() / (w[c == c[i]].sum() - 1)
        b = min(d[i, c == k].sum() / w[c == k].sum() for k in range(3) if k != c[i])
        assert (got[i]["a"], got[i]["b"]) == (pytest.approx(a, rel=1e-10), pytest.approx(b, rel=1e-10))
    placed, pairs, _ = seen[0]
    sizes = {level: placed.groupBy(F.shiftright("ix", 26 - level).alias("x"), F.shiftright("iy", 26 - level).alias("y")).count().collect() for level in seen[0][2]}
    sizes = {(level, r["x"], r["y"]): r["count"] for level, rows in sizes.items() for r in rows}
    near = sum(sizes[r["level"], r["ax"], r["ay"]] * sizes[r["level"], r["bx"], r["by"]] for r in pairs.filter("near").collect())
    assert near < len(x) ** 2 / (20 if few == 4 else 2)
    whole = sum(sizes[r["level"], r["ax"], r["ay"]] * sizes[r["level"], r["bx"], r["by"]] for r in pairs.collect())
    assert whole == len(x) ** 2
