"""Ranks of any key, and areas under many curves, against plain versions."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.functions.ordered import in_ranges, key_rank
from fathomlake.operators import curves, encode, metrics, text


def test_ranks_of_texts_with_one_start_and_no_large_range(spark):
    draw = random.Random(1)
    names = draw.sample([f"Customer#{i:09d}" for i in range(100_000)], 20_000)
    df = spark.createDataFrame([(n,) for n in names], "k string").repartition(5)
    got = {r["k"]: r["rn"] for r in key_rank(df, ["k"]).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}
    parts = in_ranges(df, ["k"]).groupBy("_part").count().collect()
    assert max(r["count"] for r in parts) < 2 * 20_000 / 4


@pytest.mark.parametrize(("kind", "values"), [("double", [0.5, -1.0, 7.25, 1e9]), ("date", ["2020-02-01", "2019-12-31"]), ("boolean", [True, False])])
def test_levels_of_any_type_are_encoded(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, *values]], "v string").select(F.col("v").cast(kind).alias("v"))
    got = {r["v"]: r["code"] for r in encode.label_encode(df, "v", "code").collect()}
    levels = sorted(v for v in got if v is not None)
    assert got == {**{v: i for i, v in enumerate(levels)}, None: None}


def test_vocabulary_has_a_dense_index(spark):
    docs = [(1, "b a a c"), (2, "a b"), (3, None), (4, "zz"), (None, "zz a")]
    counts = text.gram_counts(spark.createDataFrame(docs, "id long, t string"), "id", "t", (1,))
    got = [tuple(r) for r in text.vocabulary(counts, "id").orderBy("index").collect()]
    assert got == [("a", 2, 4, 0), ("b", 2, 2, 1), ("zz", 1, 2, 2), ("c", 1, 1, 3)]


def plain_areas(rows):
    """Collapsed areas of (y, score): one point for each x, the one met first."""
    p, n = sum(y == 1 for y, _ in rows), sum(y != 1 for y, _ in rows)
    tp = fp = 0
    roc, pr = [(0.0, 0.0)], []
    for s in sorted({s for _, s in rows}, reverse=True):
        tp += sum(y == 1 for y, t in rows if t == s)
        fp += sum(y != 1 for y, t in rows if t == s)
        roc.append((fp / n if n else 0.0, tp / p if p else 0.0))
        pr.append((tp / p if p else 0.0, tp / (tp + fp)))
    out = []
    for curve in (roc, [(0.0, pr[0][1]), *pr]):
        first = {}
        for x, y in curve:
            first.setdefault(x, y)
        x, y = np.array(list(first)), np.array(list(first.values()))
        out.append(float(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum()))
    return out


def test_areas_of_many_curves_equal_plain_ones(spark):
    draw, rows = random.Random(2), []
    for c in range(9):
        n, levels = draw.choice([1, 2, 30, 400]), draw.choice([1, 3, 50, 10_000])
        share = draw.choice([0.0, 0.1, 0.5, 1.0])
        rows += [(c, int(draw.random() < share), draw.randrange(levels) / levels) for _ in range(n)]
    df = spark.createDataFrame([*rows, (0, 1, None)], "curve int, y int, score double").repartition(3)
    got = {r["curve"]: (r["auc_roc"], r["auc_pr"]) for r in curves.areas(df).collect()}
    for c in range(9):
        own = [(y, s) for k, y, s in rows if k == c]
        assert got[c] == pytest.approx(tuple(plain_areas(own))), c
    assert curves.areas(df.limit(0)).collect() == []


def test_the_report_of_three_classes_has_their_areas(spark):
    draw = random.Random(3)
    rows = [(draw.choice("abc"), draw.choice("abcd"), draw.randrange(20) / 20, draw.random(), draw.random(), 0.5) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string, p string, a double, b double, c double, d double")
    report = {(r["scope"], r["metric"]): r["value"] for r in metrics.class_report_with_areas(df, "t", "p", {k: k for k in "abcd"}).collect()}
    roc = {k: plain_areas([(int(r[0] == k), r[2 + i]) for r in rows])[0] for i, k in enumerate("abc")}
    for k in "abc":
        assert report[k, "auc_roc"] == pytest.approx(roc[k])
    assert report["d", "auc_roc"] == report["d", "auc_pr"] == 0.0  # never the truth
    assert report["all", "auc_roc"] == pytest.approx(sum(roc.values()) / 4)
    assert curves.auc_one_vs_rest(df, "t", {k: k for k in "abcd"}) == pytest.approx(sum(roc.values()) / 4)


def test_median_scale_gathers_no_column_in_one_task(spark, monkeypatch):
    from fathomlake.operators import scale

    x = [float((i * 7919) % 30011) for i in range(30011)] + [None, 5e9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, x double")
    monkeypatch.setattr(scale.F, "median", None)  # an exact aggregate is one task
    got = {r["id"]: r["x"] for r in scale.median_scale(df, ["x"]).collect()}
    known = [v for v in x if v is not None]
    m, s = statistics.median(known), statistics.stdev(known)
    assert got[30011] is None and all(got[i] == pytest.approx((v - m) / s, abs=1e-12) for i, v in enumerate(x) if v is not None)


def test_postings_are_few_rows_a_gram_and_equal_counts_with_repeated_and_null_ids(spark):
    draw = random.Random(4)
    docs = [(i, " ".join(draw.choice(["a", "b", "É", "d1", "e-f"]) for _ in range(draw.randrange(12)))) for i in range(200)]
    docs += [(7, "a b a"), (7, None), (None, "a b"), (None, "b É"), (500, None), (501, "")]
    df = spark.createDataFrame(docs, "id long, t string").coalesce(1)
    counts = {(r["id"], r["gram"]): r["n"] for r in text.gram_counts(df, "id", "t").collect()}
    index = {r["gram"]: r for r in text.posted_vocabulary(text.gram_postings(df, "id", "t", cells=False)).collect()}
    order = sorted(index, key=lambda g: (-sum(n for (_, h), n in counts.items() if h == g), g.encode()))
    assert [index[g]["index"] for g in order] == list(range(len(order)))
    assert all(index[g]["documents"] == sum(h == g for _, h in counts) for g in order)
    got = {(r["id"], order[r["index"]]): r["n"] for r in text.posted_vectors(df, "id", "t").collect()}
    assert got == counts
    one = text.gram_postings(df.filter("id <> 7"), "id", "t")
    assert one.count() == one.select("gram").distinct().count()  # a row a gram, not a row a cell
