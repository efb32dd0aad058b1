from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from fathomlake.llm import fingerprints, queries
from fathomlake.llm.common import table


def brute_edits(texts: dict[int, str | None]) -> dict[int, str]:
    order = sorted(texts, reverse=True)
    out = {}
    for place, d in enumerate(order):
        own, other = texts[d] or "", texts[order[(place + 1) % len(order)]] or ""
        third = len(own) // 3
        out[d] = own[: len(own) - third] + other[:third]
    return out


def shingles(text: str) -> set:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_edits_and_likeness(spark, sf_dir):
    texts = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    edits, rows = brute_edits(texts), queries.op3_fingerprints(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text, wrong = {}, []
    for r in rows:
        own = texts[r["doc_id"]] or ""
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edits[r["doc_id"]].encode()).hexdigest()
        assert by_text.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        assert by_text.setdefault(edits[r["doc_id"]], r["edited_fingerprint"]) == r["edited_fingerprint"]
        wrong.append(abs(r["near_edited"] - jaccard(shingles(own), shingles(edits[r["doc_id"]]))))
    assert max(wrong) < 0.2 and sum(wrong) / len(wrong) < 0.04
    off, sizes, order = [], [], sorted(texts, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]], strict=True))
    for r in rows:
        own, edit = shingles(texts[r["doc_id"]] or ""), shingles(edits[r["doc_id"]])
        both = own | shingles(texts[following[r["doc_id"]]] or "")
        for a, b, got in ((own, edit, r["inside_edited"]), (edit, own, r["edited_inside"])):
            off.append(abs(got - (len(a & b) / len(a) if a else 1.0)))
        sizes += [abs(got / max(1, len(want)) - (1 if want else 0)) for want, got in ((own, r["n_shingles"]), (both, r["n_shingles_with_next"]))]
        assert len(own) >= 128 or r["n_shingles"] == len(own)
    assert max(off) < 0.4 and sum(off) / len(off) < 0.05
    assert max(sizes) < 0.45 and sum(sizes) / len(sizes) < 0.1


def test_edge_rows(spark):
    texts = {1: None, 2: "", 3: "a b c", 4: "é\U0001f600" * 5, 5: "word " * 30_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("edited", F.lit("x"))
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_edits(df).collect()}
    assert {d: r["edited"] for d, r in rows.items()} == brute_edits(texts)
    assert rows[1]["sketch"] == rows[2]["sketch"] == []
    assert len(rows[5]["sketch"]) == 1  # one shingle, many times
    assert fingerprints.compare_with_edits(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c c c"), (1, "c c c")], "doc_id long, text string")
    assert fingerprints.compare_with_edits(twice).count() == 4


def test_rows_of_a_repeated_id_are_dealt_by_text(spark):
    rows = [(None, f"text {i} of a row without an id " * 3) for i in range(600)] + [(i, f"row {i} " * 9) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.compare_with_edits(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    found = got.collect()
    assert len(found) == 900
    heads = {r["text"]: r["edited"][len(r["text"]) - len(r["text"]) // 3 :] for r in found if r["doc_id"] is None}
    assert len(heads) == 600 and all(("row 299 " * 9).startswith(h) and len(h) == len(t) // 3 for t, h in heads.items())


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1500, 4500))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b")).select(
        "a", "b", fingerprints.resemblance(F.col("a"), F.col("b")).alias("near"),
        fingerprints.containment(F.col("a"), F.col("b")).alias("inside"),
        fingerprints.distinct_shingles(F.col("a")).alias("n"), fingerprints.merge(F.col("a"), F.col("b")).alias("both")).first()
    assert row["near"] == pytest.approx(1 / 3, abs=0.12)
    assert row["inside"] == pytest.approx(1 / 2, abs=0.17)
    assert row["n"] == pytest.approx(2996, rel=0.3)
    assert row["both"] == sorted({*row["a"], *row["b"]})[:128]
    parts = spark.createDataFrame([("g", row["a"]), ("g", row["b"])], "k string, sketch array<long>")
    assert fingerprints.merge_groups(parts, ["k"]).first()["sketch"] == row["both"]
