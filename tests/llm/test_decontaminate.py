from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.llm import byte_words, decontaminate, queries
from fathomlake.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text: str | None, items: list[tuple], size: int = 10) -> tuple:
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(own), len(hit), ",".join(sorted(found))


def marked(docs, items, **more) -> list[tuple]:
    rows = decontaminate.mark(docs, items, **more).collect()
    return [(r["doc_id"], (r["n_words"], r["n_hit"], ",".join(r["items"]))) for r in rows]


def by_key(rows) -> list:
    return sorted(rows, key=str)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = queries.op11_decontaminate(spark, sf_dir)
    theirs = con.execute(f"select {', '.join(found.columns)} from ({queries.oracle_sql()['op11_decontaminate']})").fetchall()
    ours = [tuple(r) for r in found.collect()]
    assert sorted(ours) == sorted(theirs)
    assert sum(r[-1] for r in ours) > 0


def test_query_equals_brute_force(spark, sf_dir):
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9))}
    texts = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in queries.op11_decontaminate(spark, sf_dir).collect():
        own = words(texts[r["doc_id"]])
        if any(tuple(own[i : i + 10]) in grams for i in range(len(own))):
            n_words, n_hit, found = brute(texts[r["doc_id"]], items)
            assert (r["n_words"], r["n_hit"], r["items_sha256"]) == (n_words, n_hit, hashlib.sha256(found.encode()).hexdigest())
        else:
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(own), 0, 0)


@pytest.mark.parametrize("max_bytes", [1 << 20, 400])
def test_random_texts_equal_brute_force_in_one_part_or_several(spark, max_bytes):
    draw = random.Random(5)
    pool = ["a", "b", "Zwölf", "C3", "日本", "x" * 9, "y" * 300]
    items = [(draw.randrange(4), " - ".join(draw.choices(pool, k=draw.choice([0, 1, 2, 3, 5, 9])))) for _ in range(8)]
    docs = [(draw.randrange(30), "\n".join(draw.choices(pool, k=draw.randrange(40)))) for _ in range(40)]
    found = marked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), size=3, max_bytes=max_bytes)
    assert by_key(found) == by_key((d, brute(t, items, 3)) for d, t in docs)


def test_edge_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [(1, passage), (1, passage), (None, "solo"), (2, None), (3, " ,. "), (10, passage.upper()), (9, "short item")]
    long_text = "filler " * 300_000 + passage
    docs = [(1, None), (1, ""), (None, passage), (None, passage), (2, f"x {passage}."), (2, "solo"), (3, "a Short, item!"), (4, long_text),
            (5, "one two three four five"), (6, "six seven eight nine ten eleven")]  # no window runs over two texts
    given = spark.createDataFrame(docs, DOCS).withColumn("items", F.lit("clash")).withColumn("_id", F.lit(0)).withColumn("n_words", F.lit("x"))
    named = spark.createDataFrame(items, ITEMS).withColumn("window", F.lit(1)).withColumn("ids", F.lit(2))
    assert by_key(marked(given, named)) == by_key((d, brute(t, items)) for d, t in docs)
    for docs_left, items_left in ((given.limit(0), named), (given.limit(0), named.limit(0))):
        assert marked(docs_left, items_left) == []
    assert {r[1][1:] for r in marked(given, named.limit(0))} == {(0, "")}


def test_passages_and_documents_are_removed(spark):
    passage = "Öne two-three four five six seven eight nine ten, eleven"
    docs = [(1, f"Before it. {passage}! After 日本 it."), (2, "clean Text, untouched"), (3, None), (4, passage), (5, f"{passage} mid {passage} end")]
    given, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, passage)], ITEMS)
    left = dict(decontaminate.decontaminate(given, items).collect())
    assert left == {1: "Before it. ! After 日本 it.", 2: "clean Text, untouched", 3: "", 4: "", 5: " mid  end"}
    assert {r[0] for r in decontaminate.decontaminate(given, items, "documents").collect()} == {2, 3}
    assert {r[0] for r in decontaminate.decontaminate(given, items, "documents", max_share=0.8).collect()} == {1, 2, 3}
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.mark(given, items).collect()}
    assert docs[0][1][spans[1][0]["start"] : spans[1][0]["end"]] == passage
    with pytest.raises(ValueError, match="spans"):
        decontaminate.decontaminate(given, items, "lines")


def test_words_are_read_as_the_pattern_reads_them():
    draw = random.Random(8)
    letters = "aZ09 _-\n\t[]{}`@/:é日\x00\x7f\x80😀"
    texts = ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(300)]
    got = byte_words.read([t.encode() for t in texts])
    listed = [[] for _ in texts]
    for row, a, b, c, d in zip(got.row, got.starts, got.ends, got.raw_starts, got.raw_ends, strict=True):
        word = got.data[a:b].tobytes().decode()
        assert word == re.sub("[A-Z]", lambda m: m[0].lower(), texts[row].encode()[c:d].decode())
        listed[row].append(word)
    assert listed == [words(t) for t in texts]


def test_terms_are_matched_exactly():
    draw = random.Random(9)
    pool = ["".join(draw.choices("ab", k=n)).encode() for n in (1, 7, 8, 9, 15, 16, 17, 31, 33) for _ in range(6)] + [b"q" * 255, b"q" * 256]
    for extra in ([], [b"q" * 257, b"q" * 300]):
        terms = sorted({*pool[::2], *extra})
        lookup = byte_words.Terms(terms)
        got = byte_words.read([b" ".join([*pool, *extra, b"q" * 254])], lookup.seed)
        spots, places = lookup.match(got)
        own = [got.data[a:b].tobytes() for a, b in zip(got.starts, got.ends, strict=True)]
        assert {int(i): terms[p] for i, p in zip(spots, places, strict=True)} == {i: w for i, w in enumerate(own) if w in terms}
    assert len(byte_words.windows(np.zeros(3, np.uint64), 4)) == 0
