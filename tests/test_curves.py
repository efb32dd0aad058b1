from __future__ import annotations

import math
import random

import pytest

from fathomlake.operators import curves, metrics


def plain_points(rows: list[tuple]) -> list[tuple]:
    """(score, fpr, tpr, precision) at each threshold, by counting."""
    out = []
    for cut in sorted({s for _, s in rows}, reverse=True):
        tp, fp = (sum(s >= cut and (y == 1) == hit for y, s in rows) for hit in (True, False))
        pos = sum(y == 1 for y, _ in rows)
        out.append((cut, fp / max(len(rows) - pos, 1), tp / max(pos, 1), tp / (tp + fp)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_points_and_areas_along_the_scores(spark, seed):
    draw = random.Random(seed)
    rows = [(int(draw.random() < 0.3), round(draw.random(), 2)) for _ in range(400)]
    points = curves.threshold_points(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    want = plain_points(rows)
    got = sorted(map(tuple, points.collect()), reverse=True)
    assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    for x, y, i, j in (("fpr", "tpr", 1, 2), ("tpr", "precision", 2, 3)):
        area = sum((b[i] - a[i]) * (b[j] + a[j]) / 2 for a, b in zip(want, want[1:], strict=False))
        assert curves.auc_along(points, x, y).first()[0] == pytest.approx(area)
    backwards = points.selectExpr("score", "-fpr as x", "tpr as y")
    area = sum((b[1] - a[1]) * (b[2] + a[2]) / 2 for a, b in zip(want, want[1:], strict=False))
    assert curves.auc_along(backwards, "x", "y").first()[0] == pytest.approx(area)  # its sign is turned


@pytest.mark.parametrize("rows", [[], [(1, 0.5)], [(1, 0.5), (0, 0.5), (1, 0.5)], [(0, 0.1), (0, 0.2)]])
def test_areas_of_few_points(spark, rows):
    points = curves.threshold_points(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    assert points.count() == len({s for _, s in rows})
    assert curves.auc_along(points, "tpr", "precision").first()[0] == 0.0


def test_plain_scores(spark):
    three = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "t int, p int")
    counts = metrics.confusion(three, "t", "p")
    each = {r["label"]: r for r in metrics.plain_scores(counts, "none").collect()}
    assert each[1]["precision"] == pytest.approx(2 / 3) and each[1]["recall"] == 1.0 and each[1]["f1"] == pytest.approx(0.8)
    assert each[2]["precision"] == each[2]["recall"] == 0.0 and math.isnan(each[2]["f1"])
    p, r = (0.5 + 2 / 3) / 3, 0.5
    for average in ("macro", "binary"):
        row = metrics.plain_scores(counts, average).first()
        assert tuple(row)[1:] == pytest.approx((p, r, 2 * p * r / (p + r))) and row["label"] is None
    two = metrics.confusion(three.filter("t < 2"), "t", "p")
    assert tuple(metrics.plain_scores(two).first()) == pytest.approx((1, 2 / 3, 1.0, 0.8))
    wrong = metrics.confusion(spark.createDataFrame([(0, 1), (1, 0)], "t int, p int"), "t", "p")
    assert metrics.plain_scores(wrong).first()["f1"] == 0.0 and math.isnan(metrics.plain_scores(wrong, "macro").first()["f1"])
