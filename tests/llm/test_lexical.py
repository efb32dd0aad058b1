from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomlake.llm import lexical_search, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text: str | None) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m, score = 100 - 90 + (90 * sum(c.values()) * n) // total, 0
            for t in set(terms(text)):
                df = sum(t in x for _, x in held)
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def searched(docs, items, **more) -> list[tuple]:
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **more).collect()), key=str)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    theirs = con.execute(f"select item_id, rank, doc_id, score from ({queries.oracle_sql()['op12_lexical']})").fetchall()
    assert sorted(tuple(r) for r in queries.op12_lexical(spark, sf_dir).collect()) == sorted(theirs)


@pytest.mark.parametrize(("block_docs", "max_bytes", "k"), [(64, 1 << 20, 10), (2, 1 << 20, 3), (1, 300, 10)])
def test_random_texts_equal_brute_force(spark, block_docs, max_bytes, k):
    draw = random.Random(block_docs)
    pool = [f"w{i}" for i in range(40)] + ["Ünder", "x" * 20, "y" * 280]
    shares = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i % 70, " ".join(draw.choices(pool, shares, k=draw.choice([1, 3, 8, 30])))) for i in range(150)]
    docs += [(1000 + i, docs[0][1]) for i in range(30)]  # ties beyond k
    items = [(i % 5, ", ".join(draw.choices(pool, shares, k=draw.choice([1, 2, 6])))) for i in range(9)]
    given = spark.createDataFrame(docs, DOCS).repartition(3)
    assert searched(given, spark.createDataFrame(items, ITEMS), block_docs=block_docs, max_bytes=max_bytes, k=k) == brute(docs, items, k)


def test_edge_rows(spark):
    long_text = "filler " * 200_000 + "needle"
    docs = [(None, "needle hay"), (3, "needle hay"), (3, "needle hay"), (1, "needle hay"), (4, None), (5, " .,- "), (6, long_text), (7, "HAY, Needle needle"), (8, "other")]
    items = [(1, "Needle"), (1, "Needle"), (None, "hay other"), (2, None), (3, ""), (4, "absent words"), (5, "needle " * 3000 + "hay")]
    given = spark.createDataFrame(docs, DOCS).withColumn("query", F.lit(1)).withColumn("score", F.lit("x")).withColumn("_name", F.lit(0))
    asked = spark.createDataFrame(items, ITEMS).withColumn("query", F.lit(7)).withColumn("rank", F.lit(7)).withColumn("doc_id", F.lit(7))
    assert searched(given, asked) == brute(docs, items)
    for left, right in ((given.limit(0), asked), (given, asked.limit(0)), (given.filter("doc_id in (4, 5)"), asked)):
        assert searched(left, right) == []
    assert searched(given, asked.filter("item_id = 4")) == []


def test_bounds_are_never_below_the_scores_and_prune(spark):
    import numpy as np

    draw = random.Random(2)
    docs = [(i, " ".join(draw.choices([f"t{j}" for j in range(30)], k=12)) + (" rare words here" if i == 77 else "")) for i in range(200)]
    given = spark.createDataFrame(docs, DOCS).coalesce(1)
    asked = lexical_search.Queries(np.array([0]), sorted(b"here rare t1 words".split()), [np.arange(4)])
    forward = lexical_search.forward_index(given, asked.terms, block_docs=10).cache()
    n, total = forward.agg(F.sum("docs"), F.sum("words")).first()
    assert (n, total) == (200, 200 * 12 + 3)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in lexical_search._document_counts(forward, 4)])
    index = lexical_search.block_index(forward, n, total).collect()
    found, bounds = [], []
    for row in index:
        found.append(int(lexical_search._scores(*(np.array(row[c]) for c in ("sizes", "terms", "impacts")), weights).max()))
        bounds.append(int(next(lexical_search._bounds([np.array(row["top_terms"])], [np.array(row["tops"])], asked, weights))[0]))
    assert all(b >= s for b, s in zip(bounds, found, strict=True))
    best = max(found)
    assert sum(b >= best for b in bounds) < len(bounds) / 2  # for the best document few blocks have to be scored
