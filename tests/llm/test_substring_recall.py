"""How much of planted fuzzy passages is found, by the places at which they were planted."""

from __future__ import annotations

import random

import pytest

from fathomlake.llm import substring_dedup

VOCABULARY = [f"w{i}" for i in range(4000)]


def plant(draw: random.Random, length: int, identity: float) -> tuple[list[str], list[str], int]:
    """Two texts with a passage in common, one word in 1 / (1 - identity) replaced; where it starts in the first."""
    passage = draw.choices(VOCABULARY, k=length)
    other = list(passage)
    gap = 1 / (1 - identity)
    at = draw.uniform(0, gap)
    while at < length:
        other[int(at)] = f"new{draw.randrange(10**6)}"
        at += gap
    before = draw.choices(VOCABULARY, k=draw.randrange(40, 160))
    one = before + passage + draw.choices(VOCABULARY, k=draw.randrange(40, 160))
    two = draw.choices(VOCABULARY, k=draw.randrange(40, 160)) + other + draw.choices(VOCABULARY, k=draw.randrange(40, 160))
    return one, two, len(before)


@pytest.mark.parametrize(("identity", "least"), [(0.95, (0.93, 0.97, 0.98)), (0.9, (0.8, 0.92, 0.95)), (0.85, (0.55, 0.8, 0.88))])
def test_share_of_the_planted_words(spark, identity, least):
    draw, rows, planted = random.Random(int(identity * 100)), [], {}
    for length in (60, 120, 300):
        for _ in range(100):
            one, two, start = plant(draw, length, identity)
            planted[len(rows)] = (length, start)
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    found: dict[int, list] = {}
    for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc"], []).append((r["start"], r["end"]))
        assert r["partner"] == r["doc"] ^ 1  # its twin, and no other text
    for length, share in zip((60, 120, 300), least, strict=True):
        places = {d: s for d, (n, s) in planted.items() if n == length}
        hit = sum(any(a <= w < b for a, b in found.get(d, ())) for d, s in places.items() for w in range(s, s + length))
        assert hit / (length * len(places)) >= share, (identity, length)


def test_words_around_passages_stay(spark):
    draw, rows, planted = random.Random(1), [], {}
    for _ in range(100):
        one, two, start = plant(draw, 120, 0.95)
        planted[len(rows)] = range(start, start + 120)
        rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    outside = [w for r in spans if r["doc"] in planted for w in range(r["start"], r["end"]) if w not in planted[r["doc"]]]
    assert len(outside) <= 0.01 * 120 * 100


def test_exact_passages_of_fifty_words_are_all_found(spark):
    draw, rows, starts = random.Random(2), [], {}
    for _ in range(200):
        passage, before = draw.choices(VOCABULARY, k=50), draw.choices(VOCABULARY, k=draw.randrange(60))
        starts[len(rows)] = len(before)
        two = draw.choices(VOCABULARY, k=draw.randrange(60)) + passage + draw.choices(VOCABULARY, k=draw.randrange(60))
        rows += [(len(rows), " ".join(before + passage + draw.choices(VOCABULARY, k=draw.randrange(60)))), (len(rows) + 1, " ".join(two))]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc"], w) for r in spans for w in range(r["start"], r["end"])}
    assert all((d, w) in found for d, s in starts.items() for w in range(s, s + 50))
