"""Many models in one pass against models fitted one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.operators import logistic, many, scale, select, split


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (240, 2)) * [1.0, 50.0] + [0.0, 300.0]
    y = (x[:, 0] + (x[:, 1] - 300) / 50 + rng.normal(0, 0.7, 240) > 0.9).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y int").repartition(3).cache()


def jobs(spark, call) -> int:
    spark.sparkContext.setJobGroup("counted", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    call()
    after = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("", "")
    return len(after - before)


def test_models_equal_those_fitted_alone(spark, rows):
    folds = F.array(*[F.col("id") % 3 != i for i in range(3)])
    weighted = F.transform(folds, lambda f: F.when(f, F.when(F.col("y") == 1, 2.0).otherwise(0.5)).otherwise(0.0))
    configs = [many.Config(i, rate, penalty) for i in range(3) for rate, penalty in ((0.3, 0.0), (0.1, 2.0))]
    scaled = scale.zscore(rows, ["a", "b"])
    for sets, weight in ((folds, None), (weighted, {0: 0.5, 1: 2.0})):
        models = many.fit(scaled, ["a", "b"], "y", sets, configs, 6)
        for m, c in enumerate(configs):
            alone = logistic.fit(scaled.filter(F.col("id") % 3 != c.rows), ["a", "b"], "y", c.rate, 6, c.penalty, weight)
            assert models.one(m).weights == pytest.approx(alone.weights, rel=1e-9)
    counts = many.confusions(scaled, models, "y", F.transform(folds, lambda f: ~f))
    for m, c in enumerate(configs):
        held = scaled.filter(F.col("id") % 3 == c.rows)
        assert many.scores(counts)[m] == pytest.approx(select.score(held.withColumn("p", models.one(m).predict()), "y", "p"))
        assert many.scores(counts, "accuracy")[m] == pytest.approx(select.score(held.withColumn("p", models.one(m).predict()), "y", "p", "accuracy"))


def test_each_set_has_a_scaler_of_its_own(rows):
    marked = split.split_flags(rows, "id", 2)
    models = many.fit(marked, ["a", "b"], "y", F.col("is_train"), [many.Config(0, 0.5, 1.0), many.Config(1, 0.5, 1.0)], 7, scale=True)
    for i in range(2):
        train = marked.filter(F.col("is_train")[i])
        stats = scale.moments(train, ["a", "b"])
        alone = logistic.fit(scale.zscore(train, ["a", "b"], stats), ["a", "b"], "y", 0.5, 7, 1.0)
        theirs = scale.zscore(marked, ["a", "b"], stats).select("id", alone.probabilities()[1].alias("p")).collect()
        ours = dict(marked.select("id", models.one(i).probabilities()[1]).collect())
        assert all(ours[r["id"]] == pytest.approx(r["p"], rel=1e-9) for r in theirs)


def test_the_number_of_jobs_does_not_grow_with_the_models(spark, rows):
    fold = F.col("id") % 3
    train, held = F.array(*[fold != i for i in range(3)]), F.array(*[fold == i for i in range(3)])
    few, lots = (jobs(spark, lambda c=c: select.cross_validate(rows, ["a", "b"], "y", train, held, [(0.1, float(p)) for p in range(c)], 3, 4, scale=True)) for c in (1, 12))
    assert 0 < lots == few


def test_the_best_config_is_fitted_to_all_rows(rows):
    fold = F.col("id") % 3
    scaled = scale.zscore(rows, ["a", "b"])
    results, best = select.cross_validate(scaled, ["a", "b"], "y", F.array(*[fold != i for i in range(3)]), F.array(*[fold == i for i in range(3)]), [(0.0, 0.0), (0.5, 0.1)], 3, 5)
    assert [c for c, *_ in results] == [(0.0, 0.0), (0.5, 0.1)]
    winner = max(results, key=lambda r: r[1])[0]
    assert best.one(0).weights == pytest.approx(logistic.fit(scaled, ["a", "b"], "y", winner[0], 5, winner[1]).weights)


def test_faults_are_told(spark, rows):
    sets = F.array(F.lit(True))
    with pytest.raises(ValueError, match="two classes"):
        many.fit(rows.withColumn("y", F.lit(1)), ["a"], "y", sets, [many.Config(0)], 1)
    with pytest.raises(ValueError, match="nulls"):
        many.fit(rows.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), ["a"], "y", sets, [many.Config(0)], 1)
    with pytest.raises(ValueError, match="no rows"):
        many.fit(rows, ["a"], "y", F.array(F.lit(False)), [many.Config(0)], 1)


def test_rebalanced_rows_have_equal_classes_in_their_sets(rows):
    total = select.rebalanced(rows, "id", ["a", "b"], "y").groupBy("y").agg(*[F.sum(F.col("sets")[i]).alias(s) for i, s in enumerate(select.STRATEGIES)]).orderBy("y").collect()
    plain = [r["none"] for r in total]
    assert plain[0] != plain[1]
    for s in ("undersample", "oversample", "smote", "cost"):
        assert total[0][s] == pytest.approx(total[1][s])
    assert total[0]["undersample"] == min(plain)
    assert total[0]["smote"] == max(plain)
