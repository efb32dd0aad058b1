from __future__ import annotations

import re
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from fathomlake.llm import queries, simhash
from fathomlake.llm.common import table
from fathomlake.llm.components import connected_components


def brute_fingerprint(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    root = {d: d for d in fps}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in fps}


def test_query_equals_brute_force(spark, sf_dir):
    fps = {r[0]: brute_fingerprint(r[1]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    groups = brute_components(fps)
    rows = queries.op5_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == groups


def test_links_find_every_component_of_random_fingerprints(spark):
    import random

    draw, fps = random.Random(3), []
    for _ in range(60):
        f = draw.getrandbits(64)
        fps.append(f)
        for _ in range(draw.randrange(6)):  # a walk of up to four bits a step
            for b in draw.sample(range(64), draw.randrange(1, 5)):
                f ^= 1 << b
            fps.append(f)
    values = {i: f for i, f in enumerate(dict.fromkeys(fps))}
    signed = {f - 2**64 if f >= 2**63 else f: i for i, f in values.items()}
    for block in (4096, 2):  # lists whole, and cut into blocks
        df = spark.createDataFrame([((0, i, 0, f),) for f, i in signed.items()], f"node {simhash.NODE}")
        roots = {r["node"]["id"]: r["root"]["id"] for r in connected_components(simhash.links(df, block=block)).collect()}
        groups = brute_components(values)
        for a, b in combinations(values, 2):
            same = a in roots and b in roots and roots[a] == roots[b]
            assert same == (groups[a] == groups[b])


def test_any_four_positions_hold_an_index_key():
    kept = [set(c) for c in simhash.position_sets()]
    assert all(any(k <= set(four) for k in kept) for four in combinations(range(8), 4))


def test_edge_rows(spark):
    long = "word after word " * 50_000
    rows = [(5, None), (3, ""), (4, " \t"), (9, "one"), (7, "ONE"), (None, "one"), (9, "one"), (1, long), (2, long.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = {(r["id"], r["fp"]): r["component_id"] for r in simhash.components(df).collect()}
    assert {c for (i, _), c in got.items() if i in (3, 4, 5)} == {3}
    assert {c for (i, _), c in got.items() if i in (7, 9, None)} == {7}
    assert {c for (i, _), c in got.items() if i in (1, 2)} == {1}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7]
    assert simhash.components(df.limit(0)).count() == 0


def test_unlike_texts_with_null_or_equal_ids_all_stay(spark):
    import random

    draw = random.Random(7)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(None, t) for t in texts[:15]] + [(9, t) for t in texts[15:30]] + [(i, t) for i, t in enumerate(texts[30:], 100)]
    copies = [(None, texts[0]), (None, texts[35]), (9, texts[20]), (12, texts[21]), (3, texts[2])]
    kept = simhash.keep_one(spark.createDataFrame(rows + copies, "doc_id long, text string"))
    expected = [(3 if t == texts[2] else i, t) for i, t in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_a_hub_and_a_chain_are_one_component_each(spark):
    hub = [(0, i) for i in range(1, 3000)]
    chain = [(10_000 + i, 10_001 + i) for i in range(12)]
    df = spark.createDataFrame(hub + chain, "u long, v long")
    roots = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert roots == {i: 0 for i in range(3000)} | {10_000 + i: 10_000 for i in range(13)}
