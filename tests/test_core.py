"""Operators that no registered query reaches, and edge rows of others."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomlake.functions.ordered import quantiles
from fathomlake.operators import clean, features, impute, kmeans, lda, logistic, metrics, mlp, pca, prepare, profile, resample, scale, text
from fathomlake.plans import catalog
from fathomlake.sources import readers, writers
from fathomlake.streaming import score


@pytest.mark.parametrize("limit", [10_000, 50])
def test_quantiles_equal_numpy(spark, limit):
    draw = np.random.default_rng(3)
    frame = pd.DataFrame({"a": draw.normal(size=20_001), "b": draw.integers(0, 5, 20_001).astype(float), "c": [1.5] * 20_000 + [9.0], "d": [None] * 20_001})
    frame.loc[::7, "a"] = None
    df = spark.createDataFrame(frame.astype({"d": "float64"})).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("a", "d")})
    asked = (0.0, 0.15, 0.5, 0.85, 1.0)
    found = quantiles(df, ["a", "b", "c", "d"], asked, limit)
    for c in ("a", "b", "c"):
        assert found[c] == pytest.approx(np.nanquantile(frame[c].to_numpy(float), asked).tolist()), c
    assert found["d"] == [None] * 5
    assert quantiles(df.limit(0), ["a"], asked) == {"a": [None] * 5}
    ends = df.withColumn("a", F.when(F.col("b") == 0, float("-inf")).when(F.col("b") == 4, float("inf")).otherwise(F.col("a")))
    values = np.select([frame["b"] == 0, frame["b"] == 4], [-np.inf, np.inf], frame["a"].to_numpy(float))
    assert quantiles(ends, ["a"], (0.4, 0.5, 0.6), limit)["a"] == pytest.approx(np.nanquantile(values, (0.4, 0.5, 0.6)).tolist())


def test_quantiles_among_heavy_values_gather_little(spark):
    frame = pd.DataFrame({"a": [1.0] * 30_000 + [2.0 + i / 1000 for i in range(900)] + [5.0] * 30_000})
    found = quantiles(spark.createDataFrame(frame), ["a"], (0.499, 0.5, 0.501), 200)["a"]
    assert found == pytest.approx(np.quantile(frame["a"], (0.499, 0.5, 0.501)).tolist())


def test_csv_round_trip_and_posterior_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.25, 0.75]), (2, [1.0, 0.0])], "id int, p array<double>")
    writers.write_csv(writers.posterior_columns(df, "p", ["x", "y"]).withColumn("gap", F.when(F.col("id") > 1, F.lit(float("nan")))), str(tmp_path / "csv"))
    back = readers.csv(spark, str(tmp_path / "csv"), "id int, class_x double, class_y double, gap double")
    assert sorted(map(tuple, back.collect())) == [(1, 0.25, 0.75, None), (2, 1.0, 0.0, None)]


def test_arrays_and_images_are_read(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(24).reshape(4, 2, 3))
    rows = readers.npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()
    assert [r["x"] for r in rows] == np.arange(24).reshape(4, 6).astype(float).tolist()
    (tmp_path / "img").mkdir()
    for name in "ab":
        (tmp_path / "img" / f"{name}.bin").write_bytes(name.encode())
    notes = spark.createDataFrame([("a.bin", 1), ("b.bin", 2), ("c.bin", 3)], "f string, y int")
    got = readers.image_folder(spark, str(tmp_path / "img"), notes, "f", "y", F.length("content")).collect()
    assert sorted((r["file"], r["label"], r["content"]) for r in got) == [("a.bin", 1, 1), ("b.bin", 2, 1)]


def test_shuffled_batches_hold_every_row(spark):
    got = readers.shuffled_batches(spark.range(1000), "id", 100).groupBy("batch_id").count().collect()
    assert len(got) == 10 and sum(r["count"] for r in got) == 1000 and max(r["count"] for r in got) < 200


def test_models_are_saved_and_loaded(spark, tmp_path):
    model = logistic.LogisticModel(("a", "b"), (0, 1), np.array([[0.5], [1.0], [-2.0]]))
    writers.save_model(spark, model, str(tmp_path / "m"))
    back = writers.load_model(spark, logistic.LogisticModel, str(tmp_path / "m"))
    assert back.features == model.features and back.classes == model.classes and np.array_equal(back.weights, model.weights)
    with pytest.raises(ValueError):
        writers.load_model(spark, kmeans.KMeansModel, str(tmp_path / "m"))


def test_a_stream_is_scored_and_counted_as_the_batch(spark, sf_dir, tmp_path):
    events = readers.table(spark, sf_dir, "events").select("event_id", "value", F.col("ts").cast("timestamp").alias("ts")) if "ts" in readers.table(spark, sf_dir, "events").columns else None
    if events is None:
        events = readers.table(spark, sf_dir, "events").select("event_id", "value", F.timestamp_seconds(F.col("event_id") * 60).alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = score.scored(score.parquet_stream(spark, str(tmp_path / "in"), events.schema), F.col("value") * 2)
    score.run_to_table(stream, "scored_stream").awaitTermination()
    assert spark.table("scored_stream").exceptAll(events.withColumn("prediction", F.col("value") * 2)).count() == 0
    assert spark.table("scored_stream").count() == events.count()
    counted = score.windowed_counts(stream, "ts", [], "10 minutes", "3650 days")
    score.run_to_table(counted, "counted_stream", "complete").awaitTermination()
    assert spark.table("counted_stream").agg(F.sum("n")).first()[0] == events.count()


def test_profile_helpers(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (0, 10.0), (0, None)], "flag int, x double")
    assert profile.schema_info(df) == [("flag", "int"), ("x", "double")]
    assert profile.conditional_means(df, "flag", ["x"]).first().asDict() == {"x_1": 3.0, "x_0": 10.0}


def test_outliers_of_each_cluster_become_null(spark):
    values = [1.0, 1.1, 1.2, 1.3, 5.0, 100.0, 100.1, 100.2, 100.3, 90.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    got = {r["id"]: r["x"] for r in clean.cluster_outliers_to_null(df, "x", "id").collect()}
    assert [i for i, v in enumerate(values) if v is not None and got.get(i) is None] == [4, 9]


def test_scaling_and_weights(spark):
    assert scale.unscaled_coefficients({"a": 6.0, "b": 1.0}, scale.Moments({"a": 0.0, "b": 0.0}, {"a": 3.0, "b": 0.0})) == {"a": 2.0}
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(4)], "id int, y int")
    assert {r["label"]: r["weight"] for r in resample.inverse_share_weights(df, "y").collect()} == {0: 4 / 3, 1: 4.0}


def test_vae_loss_equals_numpy(spark):
    x, p, m, v = [0.0, 1.0], [0.2, 0.7], [0.5, -1.0], [0.1, -0.3]
    got = metrics.vae_loss(spark.createDataFrame([(x, p, m, v)] * 2, "x array<double>, p array<double>, m array<double>, v array<double>"), "x", "p", "m", "v", 0.5).first()[0]
    bce = -math.log(0.8) - math.log(0.7)
    assert got == pytest.approx(2 * (bce + 0.5 * sum(-0.5 * (1 + b - a * a - math.exp(b)) for a, b in zip(m, v, strict=True))))


def _two_classes(spark, n=120):
    draw = np.random.default_rng(1)
    y = np.arange(n) % 2
    x = draw.normal(size=(n, 2)) + 1.5 * y[:, None]
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y int"), x, y


def test_legacy_logistic_equals_numpy(spark):
    df, x, y = _two_classes(spark)
    w, design = np.zeros(3), np.column_stack([np.ones(len(x)), x])
    for _ in range(15):
        slope = design.T @ (1 / (1 + np.exp(-design @ w)) - y) / len(y)
        slope[1:] += 0.1 * w[1:]
        w -= 0.3 * slope
    got = logistic.fit_legacy(df, ["a", "b"], "y", 0.3, 15, 0.1, 0.0)
    assert got.weights[:, 0] == pytest.approx(w)


def test_kmeans_until_labels_settle(spark):
    draw = np.random.default_rng(2)
    centres = np.array([[0.0, 0.0], [20.0, 0.0], [0.0, 20.0]])
    points = np.concatenate([c + draw.normal(size=(30, 2)) for c in centres])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    model = kmeans.fit_until_labels_settle(df, "id", "v", 3)
    near = ((points[:, None] - model.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert model.centres == pytest.approx(np.array([points[near == k].mean(axis=0) for k in range(3)]))


@pytest.mark.parametrize("batch_norm", [False, True])
def test_network_gradients_equal_differences(batch_norm):
    draw = np.random.default_rng(7)
    options = mlp.Options(hidden=(5, 4), batch_norm=batch_norm)
    net = mlp.initialise([3, 5, 4, 3], [0, 1, 2], options)
    for p in (*net.biases, *net.betas):  # off the kinks
        p += draw.normal(size=p.shape)
    x, y = draw.normal(size=(12, 3)), draw.integers(0, 3, 12)
    found, _, _ = mlp.gradients(net, x, y)
    params = [*net.weights, *net.biases, *net.gammas, *net.betas]

    def loss() -> float:
        return mlp.gradients(net, x, y)[1]

    for p, g in zip(params, found, strict=True):
        for at in list(np.ndindex(p.shape))[:6]:
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-4)


def test_experiments_and_tuning(spark):
    df, _, _ = _two_classes(spark, 80)
    df = df.select("id", F.array("a", "b").alias("v"), "y")
    train, held = df.filter("id % 5 > 0"), df.filter("id % 5 = 0")
    configs = {"one": mlp.Options(hidden=(4,), epochs=2), "two": mlp.Options(hidden=(4,), epochs=2, batch_norm=True, optimiser="adam", rate=0.01)}
    history = mlp.run_experiments(train, "v", "y", "id", configs, held)
    assert {(h[0], h[1]) for h in history} == {(n, e) for n in configs for e in range(2)}
    best = mlp.tune_in_turn(train, "v", "y", "id", mlp.Options(hidden=(4,), epochs=8), {"rate": (1e-9, 0.1)}, held)
    assert best.rate == 0.1


def test_preparation_keeps_held_out_rows_out(spark):
    rows = [(i, None if i % 5 == 0 else float(i), i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    for label in (None, "y"):
        train, held, stats = prepare.split_impute_scale(df, "id", ["x"], 0.8, label=label)
        t, h = train.collect(), held.collect()
        assert len(t) == 40 and len(h) == 10 and {r["id"] for r in t}.isdisjoint(r["id"] for r in h)
        known = [rows[r["id"]][1] for r in t if rows[r["id"]][1] is not None]
        full = [float(np.mean(known)) if rows[r["id"]][1] is None else rows[r["id"]][1] for r in t]
        assert stats.means["x"] == pytest.approx(np.mean(full)) and stats.stds["x"] == pytest.approx(np.std(full, ddof=1))


def test_monomials_and_drawn_powers():
    assert list(features.monomials(["a", "b"], 2)) == ["a1", "b1", "a2", "a1_b1", "b2"]
    drawn = features.drawn_powers(["a", "b", "c"])
    assert drawn == features.drawn_powers(["a", "b", "c"]) and len(drawn) <= 300 and {c for c, _ in drawn} == {"a", "b", "c"}
    assert all(2 <= p <= 11 for _, p in drawn)


def test_imputation_in_order_fills_the_other_columns(spark):
    rows = [(i, float(i), None if i == 3 else 2.0, None if i == 4 else 1.0, i % 2, None if i == 5 else 7.0) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, area double, rooms double, age double, house int, lat double")
    got = {r["id"]: r for r in impute.impute_in_order(df, "rooms", "area", "age", "house", "id", 5, ["lat"]).collect()}
    assert got[3]["rooms"] == 2.0 and got[4]["age"] == 1.0 and got[5]["lat"] == 7.0 and len(got) == 12


def test_vocabulary_is_dense_and_ordered(spark):
    draw = random.Random(4)
    words = [f"w{draw.randrange(300)}" for _ in range(400)] + ["the cat", "then", "the", "th", "ähre", "zoo"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(900, None), (901, "")], "id long, t string")
    rows = text.vocabulary(text.gram_counts(df, "id", "t"), "id").collect()
    assert sorted(r["index"] for r in rows) == list(range(len(rows)))
    assert [r["gram"] for r in sorted(rows, key=lambda r: r["index"])] == [r["gram"] for r in sorted(rows, key=lambda r: (-r["total"], r["gram"].encode()))]


@pytest.mark.parametrize("name", ["predict_price", "lda_predict", "smote", "logistic_predict", "split_impute_scale", "polynomial_terms"])
def test_queries_cover_their_whole_table(name):
    assert name in catalog.QUERIES and name in catalog.ORACLES
    assert "% 10 = 0" not in catalog.ORACLES[name] and "label < " not in catalog.ORACLES[name].replace("label < 1", "")


def test_large_means_do_not_cancel(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(500, 3)) @ np.diag([1.0, 2.0, 0.5]) + 1e8
    df = spark.createDataFrame([(p.tolist(), *map(float, p), i % 2) for i, p in enumerate(x)], "v array<double>, a double, b double, c double, y int")
    model = pca.fit(df, "v")
    assert model.values == pytest.approx(np.linalg.eigvalsh(np.cov(x, rowvar=False))[::-1], rel=1e-6) and model.mean == pytest.approx(x.mean(axis=0))
    found = lda.fit(df, ["a", "b", "c"], "y")
    within = sum((x[i::2] - x[i::2].mean(axis=0)).T @ (x[i::2] - x[i::2].mean(axis=0)) for i in (0, 1)) / 498
    assert found.covariance == pytest.approx(within, rel=1e-5, abs=1e-7) and found.means == pytest.approx(np.array([x[i::2].mean(axis=0) for i in (0, 1)]))
