from __future__ import annotations

import random

from pyspark.sql import functions as F

from fathomlake.llm import substring_dedup as sd
from fathomlake.llm.common import bucketed, join_buckets


def prose(draw: random.Random, n: int) -> list[str]:
    return [f"w{draw.randrange(50_000)}" for _ in range(n)]


def spans_and_third(spark, monkeypatch, docs: dict[int, str]) -> tuple[dict[int, list], list]:
    third, seen = sd.third_matches, []

    def kept(*args):
        seen.append(third(*args))
        return seen[-1]

    monkeypatch.setattr(sd, "third_matches", kept)
    found: dict[int, list] = {}
    for r in sd.repeated_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect():
        found.setdefault(r["doc"], []).append((r["start"], r["end"]))
    return found, seen


def test_a_common_rare_run_where_no_passage_is_possible_makes_no_partners(spark, monkeypatch):
    """All texts hold 45 words that are too few for a passage; two each hold three words far from them, two more the words around them."""
    draw = random.Random(3)
    item, docs = prose(draw, 45), {}
    for d in range(0, 40, 2):
        rare = prose(draw, 3)
        for e in (d, d + 1):
            docs[e] = " ".join(prose(draw, 60) + item + prose(draw, 30) + rare + prose(draw, 60))
    around = prose(draw, 6)
    for d in (100, 101):
        docs[d] = " ".join(prose(draw, 60) + item + around + prose(draw, 60))
    found, seen = spans_and_third(spark, monkeypatch, docs)
    assert found == {100: [(60, 111)], 101: [(60, 111)]}
    pairs = {tuple(r) for r in seen[0].select("t", "partner").distinct().collect()} if seen and seen[0] is not None else set()
    assert len(pairs) <= 2


def test_ids_keep_all_their_bits():
    import pandas as pd

    t, u = 2**62 + 12_345_677, -(2**61) - 7_654_321
    rows = [(t, 0, 5, 40, True, 0, 0)] + [(t, 1, p, 0, False, p, 20) for p in range(60)] + [(t, 2, 60, 0, False, u, 0)]
    frame = pd.DataFrame(rows, columns=["t", "kind", "place", "then", "open", "run", "held"])
    out = pd.concat(list(sd._filled(50)(iter([frame]))))
    assert out["partner"].dropna().tolist() == [u] and set(out["t"]) == {t} and out["run"].notna().any()


def test_joins_leave_bucketed_rows_where_they_are(spark):
    right = bucketed(spark.range(400).select(F.col("id").alias("t"), F.concat(F.lit("v"), "id").alias("v")), "t")
    left = spark.range(5_000).select(F.when(F.col("id") < 3_000, 7).otherwise(F.col("id") % 500).alias("t"), F.col("id").alias("x"))
    want = {(x, 7 if x < 3_000 else x % 500) for x in range(5_000) if x < 3_000 or x % 500 < 400}
    got = join_buckets(left, right, "t", "x")
    assert {(r["x"], r["t"]) for r in got.collect()} == want and got.filter(F.col("v") != F.concat(F.lit("v"), "t")).isEmpty() and got.count() == len(want)
    even = join_buckets(spark.range(50).select(F.col("id").alias("t"), F.col("id").alias("x")), right, "t", "x")
    assert even._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(t") == 1
    assert not spark.catalog.listTables("default") or not any(x.name.startswith("bucketed_") for x in spark.catalog.listTables("default"))
