from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomlake.llm import mixing, queries
from fathomlake.llm.common import table


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 20), min_size=1))
@settings(max_examples=100, deadline=None)
def test_a_period_serves_each_block_in_its_window(weights):
    slots, total, given_ = mixing.period(weights), sum(weights.values()), Counter()
    for t, s in enumerate(slots):
        assert given_[s] * total // weights[s] <= t < -(-(given_[s] + 1) * total // weights[s])
        given_[s] += 1
        assert all(abs(given_[x] - (t + 1) * w / total) < 1 for x, w in weights.items())
    assert given_ == weights


@given(st.dictionaries(st.sampled_from("abcd"), st.tuples(st.integers(1, 9), st.integers(0, 40)), min_size=1))
@settings(max_examples=100, deadline=None)
def test_phases_give_every_block_a_slot_of_its_own(sources):
    weights, blocks = {s: w for s, (w, _) in sources.items()}, {s: n for s, (_, n) in sources.items()}
    slots = []
    for s, place, nth, per, lo, hi, start, whole in mixing.phases(weights, blocks):
        slots += [start + (b - lo) // per * whole + place for b in range(lo, hi + 1) if (b - lo) % per == nth]
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_query_places_every_document_once(spark, sf_dir):
    sources = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "source").collect()}
    rows = queries.op6_mixing(spark, sf_dir).collect()
    assert {r["doc_id"]: r["source"] for r in rows} == sources and len(rows) == len(sources)
    taken = defaultdict(set)
    for r in rows:
        taken[r["slot"]].add((r["mix_source"], r["block"]))
        assert 0 <= r["row_in_block"] < 64
    assert sorted(taken) == list(range(len(taken))) and all(len(b) == 1 for b in taken.values())


def test_deviation_is_under_one_block(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 4 == 1, "b").otherwise(F.lit(None)).alias("source"))
    df = df.withColumn("_slot", F.lit("clash"))
    weights, rest = {"a": 5, "b": 3}, 2
    rows = mixing.mix(df, weights, rest, block_rows=10).select("_mix_source", "_slot", "_release", "_deadline").distinct().orderBy("_slot").collect()
    served, share = Counter(), {"a": 0.5, "b": 0.3, "*": 0.2}
    ends = {"a": 200, "b": 100, "*": 100}
    for t, r in enumerate(rows):
        served[r["_mix_source"]] += 1
        assert r["_release"] <= t < r["_deadline"]
        if all(served[s] < ends[s] for s in ends):
            assert all(abs(served[s] - (t + 1) * w) < 1 for s, w in share.items())
    assert served == ends


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a"), (1, "a"), (2, None)]])
def test_edge_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string")
    assert sorted(map(str, mixing.mix(df, {"a": 1}).select("doc_id", "source").collect())) == sorted(map(str, df.collect()))
    assert mixing.in_mixture_order(mixing.mix(df, {"a": 1}), df.columns).count() == len(rows)


def test_the_query_equals_a_schedule_rebuilt_row_by_row(spark, sf_dir):
    rows = queries.op6_mixing(spark, sf_dir).collect()
    blocks = defaultdict(list)
    for r in rows:
        blocks[r["mix_source"], r["block"]].append(r["row_in_block"])
    assert all(sorted(b) == list(range(len(b))) for b in blocks.values())
    left = Counter(s for s, _ in blocks)
    assert all(len(b) == 64 or n == left[s] - 1 for (s, n), b in blocks.items())
    weights, given, order = {**queries.MIX_WEIGHTS, "*": queries.MIX_REST}, Counter(), []
    while left:  # a phase: until the first source runs out
        share, served = sum(weights[s] for s in left), Counter()
        for t in range(10**6):
            due = [(-(-(served[s] + 1) * share // weights[s]), -weights[s], s) for s in left if served[s] * share // weights[s] <= t]
            source = min(due)[2]
            order.append((source, given[source]))
            served[source] += 1
            given[source] += 1
            left[source] -= 1
            if not left[source]:
                del left[source]
                break
    assert order == [b for _, b in sorted({(r["slot"], (r["mix_source"], r["block"])) for r in rows})]


def test_rows_of_one_key_are_dealt_to_many_parts(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("text "), "id").alias("text"))
    mixed = mixing.mix(df, {"a": 1})
    order = [r["text"] for r in mixed.orderBy("_slot", "_row").collect()]
    assert sorted(order) == sorted(f"text {i}" for i in range(6000))
    places = [i for i, t in enumerate(order) if int(t.split()[1]) % 3 == 0]  # those of the null key
    assert max(b - a for a, b in zip(places, places[1:], strict=False)) < 60 and abs(sum(places) / 2000 - 3000) < 150
    again = mixing.mix(df.repartition(7, "text"), {"a": 1})
    assert [r["text"] for r in again.orderBy("_slot", "_row").collect()] == order


def test_clashing_names_of_keys(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 6, "y"), (2, "b", 6, "z")], "doc_id long, source string, lo long, nth string")
    df = df.withColumns({"p_source": F.lit(1), "_key": F.lit(2), "_spread": F.lit(3), "place": F.lit(4)})
    assert sorted(mixing.mix(df, {"a": 1}).select(*df.columns).collect()) == sorted(df.collect())


def test_weights_must_be_positive(spark):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a")], "doc_id long, source string"), {"a": 0})
