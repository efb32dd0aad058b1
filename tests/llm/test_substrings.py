from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.llm import substring_dedup as sd


def prose(draw: random.Random, n: int) -> list[str]:
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def test_best_chain_equals_quadratic_search():
    draw = np.random.default_rng(5)
    for _ in range(100):
        n = int(draw.integers(1, 25))
        x, y = np.sort(draw.integers(0, 60, n)), draw.integers(0, 60, n)
        best = []
        for j in range(n):
            before = [best[i] - sd.GAP_COST * (x[j] - x[i] + y[j] - y[i]) for i in range(j) if x[i] < x[j] and y[i] < y[j]]
            best.append(sd.K + max([0.0, *before]))
        chain = sd.best_chain(x, y)
        if np.all(np.diff(x) > 0) and np.all(np.diff(y) > 0):
            assert chain == list(range(n))
            continue
        steps = list(zip(chain, chain[1:], strict=False))
        assert all(x[i] < x[j] and y[i] < y[j] for i, j in steps)
        worth = sd.K * len(chain) - sum(sd.GAP_COST * (x[j] - x[i] + y[j] - y[i]) for i, j in steps)
        assert worth == pytest.approx(max(best))


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    draw = random.Random(11)
    exact, fuzzy = prose(draw, 80), prose(draw, 120)
    rows, planted = [], {}
    for d in range(60):
        words = prose(draw, draw.randrange(100, 400))
        at = draw.randrange(len(words))
        if d % 3 == 0:
            passage = exact
        elif d % 3 == 1:
            passage = [("x" + str(draw.random()) if i % 30 == 17 else w) for i, w in enumerate(fuzzy)]
        else:
            passage = []
        if passage:
            planted[d] = (at, at + len(passage))
        rows.append((d, " ".join(words[:at] + passage + words[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("partner", F.lit(1))
    found = {}
    for r in sd.repeated_spans(df).collect():
        assert r["doc"] not in found
        found[r["doc"]] = (r["start"], r["end"])
        assert r["partner"] in planted and r["partner"] % 3 == r["doc"] % 3 and r["identity"] >= sd.MIN_IDENTITY
    assert found.keys() == planted.keys()
    for d, (start, end) in planted.items():
        assert abs(found[d][0] - start) <= 20 and abs(found[d][1] - end) <= 20
        if d % 3 == 0:
            assert found[d] == (start, end)


def test_edge_rows(spark):
    same = " ".join(f"q{i}" for i in range(70))
    loop = "again and " * 20_000
    rows = [(1, None), (2, ""), (3, "short text"), (4, same), (5, same), (None, same), (6, loop), (7, loop)]
    got = {r["doc"]: (r["start"], r["end"], r["partner"]) for r in sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4] == (0, 70, 5) and got[5] == (0, 70, 4)
    assert got[6][2] == 7 and got[7][2] == 6 and got[6][1] - got[6][0] > 39_000
    assert got.keys() == {4, 5, 6, 7}
    assert sd.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_one_chain_are_found_apart(spark):
    draw, rows, planted = random.Random(23), [], {}
    for pair in range(12):
        first, second = prose(draw, 55), prose(draw, 55)
        for d in (2 * pair, 2 * pair + 1):
            # 30 differing words between them, or 30 words in the second document alone
            between = prose(draw, 30 if pair % 2 == 0 or d % 2 else 0)
            lead, trail = prose(draw, draw.randrange(30, 90)), prose(draw, draw.randrange(30, 90))
            at, then = len(lead), len(lead) + 55 + len(between)
            planted[d] = [(at, at + 55), (then, then + 55)] if between else [(at, at + 110)]
            rows.append((d, " ".join(lead + first + between + second + trail)))
    found: dict[int, list] = {}
    for r in sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["partner"] == r["doc"] ^ 1
        found.setdefault(r["doc"], []).append((r["start"], r["end"]))
    assert {d: sorted(spans) for d, spans in found.items()} == planted


def test_a_wide_gap_of_a_chain_hides_no_other_match():
    x, y = np.array([0, 10, 30, 60, 70]), np.array([0, 10, 900, 60, 70])
    assert (30, 30 + sd.K, 900, 900 + sd.K) in sd._chains(x, y)


def brute_spans(docs: dict[int, str], min_words: int = 50) -> dict[int, list[tuple[int, int]]]:
    """Merged passages of each document, every pair of documents chained and aligned."""
    codes = {d: sd.word_codes(t) for d, t in docs.items()}
    held = {d: [(int(p), int(s)) for p, s in zip(*sd.seeds(c), strict=True)] for d, c in codes.items()}
    spans: dict[int, list] = {d: [] for d in docs}
    for a in docs:
        for b in docs:
            if a == b:
                continue
            places: dict[int, list] = {}
            for p, s in held[b]:
                places.setdefault(s, []).append(p)
            met = sorted((p, q) for p, s in held[a] for q in places.get(s, ()))
            if len(met) < 2:
                continue
            for x0, x1, y0, y1 in sd._chains(np.array([m[0] for m in met]), np.array([m[1] for m in met])):
                x, y = max(0, x0 - sd.WINDOW), max(0, y0 - sd.WINDOW)
                for i, j, k, m, _ in sd._align(codes[a][x : x1 + sd.WINDOW], codes[b][y : y1 + sd.WINDOW]):
                    if max(j - i, m - k) >= min_words:
                        spans[a].append((x + i, x + j))
                        spans[b].append((y + k, y + m))
    return {d: merged(s) for d, s in spans.items() if s}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def spans_of(spark, docs: dict[int, str]) -> dict[int, list[tuple[int, int]]]:
    found: dict[int, list] = {}
    for r in sd.repeated_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect():
        found.setdefault(r["doc"], []).append((r["start"], r["end"]))
    return {d: sorted(s) for d, s in found.items()}


def covered(inner: dict, outer: dict, edge: int) -> bool:
    """Does every span of inner lie in one of outer but for ``edge`` words at its ends."""
    return all(any(s >= a - edge and e <= b + edge for a, b in outer.get(d, [])) for d, spans in inner.items() for s, e in spans)


def edited(draw: random.Random, words: list[str], every: int) -> list[str]:
    out = []
    for i, w in enumerate(words):
        kind = draw.randrange(3) if i % every == every - 1 else None
        out += [w] if kind is None else [f"e{draw.random()}"] if kind == 0 else [w, f"e{draw.random()}"] if kind == 1 else []
    return out


def crowd(draw: random.Random) -> dict[int, str]:
    """Fuzzy copies and shifted slices of one passage, near and exact copies, short slices."""
    passage, docs = prose(draw, 400), {}
    for d in range(0, 60, 2):
        start, size = draw.randrange(300), draw.choice([30, 30, 60, 100, 200])
        piece = passage[start : start + size]
        docs[d] = prose(draw, draw.randrange(20, 120)) + edited(draw, piece, draw.choice([15, 25, 1000])) + prose(draw, draw.randrange(20, 120))
    base = prose(draw, 150)
    for d in range(101, 121, 2):
        docs[d] = edited(draw, base, draw.choice([20, 40, 1000]))
    docs[500] = prose(draw, 100) + edited(draw, passage, 25) + prose(draw, 60)
    docs[501] = prose(draw, 30) + edited(draw, passage, 30) + prose(draw, 90)
    return {d: " ".join(w) for d, w in docs.items()}


def test_spans_equal_brute_force_over_all_pairs(spark):
    docs = crowd(random.Random(2))
    found, want = spans_of(spark, docs), brute_spans(docs)
    assert len(want) > 20
    assert covered(want, found, sd.WINDOW) and covered(found, want, sd.WINDOW)


def test_other_documents_hide_no_passage(spark):
    draw = random.Random(8)
    passage = prose(draw, 400)
    two = {d: " ".join(prose(draw, 100) + edited(draw, passage, 24) + prose(draw, 50)) for d in (500, 600)}
    alone = spans_of(spark, two)
    assert sum(e - s for s, e in alone[500]) > 300
    for n, pieces in ((40, 1), (300, 6)):  # seeds with some holders, and with more than HELD
        others = {}
        for i in range(n):
            starts = [draw.randrange(370) for _ in range(pieces)]
            words = [w for s in starts for w in prose(draw, 40) + passage[s : s + 30]]
            others[i if i % 2 else 1000 + i] = " ".join(words + prose(draw, 40))
        both = spans_of(spark, two | others)
        assert covered(alone, both, sd.WINDOW), (n, alone, both[500], both[600])


def test_equal_blocks_are_equal_and_in_order():
    draw = random.Random(1)
    for _ in range(200):
        a = [draw.randrange(draw.choice([3, 40, 10_000])) for _ in range(draw.randrange(120))]
        b = edited(draw, [str(x) for x in a], draw.randrange(2, 20))
        x, y = (np.array([hash(str(w)) & 0xFFFFFFFF for w in t], np.uint32) for t in (a, b))
        end_a = end_b = 0
        for i, j, size in sd.equal_blocks(x, y):
            assert size >= 1 and i >= end_a and j >= end_b and (x[i : i + size] == y[j : j + size]).all()
            end_a, end_b = i + size, j + size


def test_different_texts_of_one_id(spark):
    draw = random.Random(3)
    a, b = prose(draw, 80), prose(draw, 80)
    rows = [(1, " ".join(a)), (1, " ".join(a)), (1, " ".join(prose(draw, 30) + a)), (2, " ".join(b + prose(draw, 9))), (3, " ".join(prose(draw, 5) + b))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("x"))
    found = sorted((r["doc"], r["start"], r["end"], r["partner"]) for r in sd.repeated_spans(df).collect())
    assert found == [(2, 0, 80, 3), (3, 5, 85, 2)]


@pytest.mark.parametrize("whole", [1, 3])
def test_texts_with_the_same_seeds_hide_no_passage(spark, whole):
    """Decoys hold all seeds of a passage at its gaps, so that each of its pairs is frequent, but not its other words.

    With three parts of which each decoy holds one as a whole, all runs of words are frequent too.
    """
    draw = random.Random(31)
    passage = prose(draw, 66)
    picks, _ = sd.seeds(sd.word_codes(" ".join(passage)))
    fixed = {int(p) + i for p in picks for i in range(sd.K)}
    near = [f"y{i}" if i in sorted(set(range(10, 60)) - fixed)[::9] else w for i, w in enumerate(passage)]
    docs = {}
    for d in range(60):
        kept = fixed if whole == 1 else fixed | set(range(d % 3 * 22, d % 3 * 22 + 22))
        docs[d] = " ".join(prose(draw, 120) + [w if i in kept else f"d{draw.random()}" for i, w in enumerate(passage)] + prose(draw, 120))
    for d, words in ((100, passage), (101, near if whole == 1 else passage)):
        docs[d] = " ".join(prose(draw, 150) + words + prose(draw, 150))
    found = spans_of(spark, docs)
    for d in (100, 101):
        assert any(start <= 155 and end >= 211 for start, end in found.get(d, [])), found


def test_words_said_again_and_again_meet_few_texts(spark, monkeypatch):
    """Stretches of one frequent word are in all texts; those that make passages are found without all pairs of texts."""
    draw, docs = random.Random(5), {}
    for d in range(240):
        docs[d] = prose(draw, 70) + [f"u{d}"] * 40 + ["de"] * draw.randrange(40, 49) + [f"v{d}"] * 40 + prose(draw, 70)
        docs[1000 + d] = prose(draw, 70) + [f"x{d}"] * 40 + ["la"] * draw.randrange(40, 49) + [f"y{d}"] * 40 + prose(draw, 70)
    for d, n in ((500, 54), (501, 74)):  # one word
        docs[d] = prose(draw, 90) + ["de"] * n + prose(draw, 90)
    for d in (600, 601):  # two words
        docs[d] = prose(draw, 90) + ["de"] * 30 + ["la"] * 30 + prose(draw, 90)
    for d in (700, 701):  # one word, with others between
        docs[d] = prose(draw, 90) + ["de"] * 30 + prose(draw, 3) + ["de"] * 30 + prose(draw, 90)
    pairs, third = [], sd.third_matches

    def counted(*args):
        matches = third(*args)
        pairs.append(matches.select("t", "partner").distinct().count())
        return matches

    monkeypatch.setattr(sd, "third_matches", counted)
    found = spans_of(spark, {d: " ".join(w) for d, w in docs.items()})
    for d, n in ((500, 54), (501, 54), (600, 60), (601, 60), (700, 54), (701, 54)):
        assert any(start <= 92 and end >= 88 + n for start, end in found.get(d, [])), (d, found.get(d))
    assert pairs and pairs[0] <= 8 * len(docs)


def test_runs_of_many_batches_are_counted_by_texts():
    """Of sorted rows, cut anywhere, a run is frequent if more than HELD texts have it, however often."""
    import pandas as pd

    rows = [(t, run, place) for run, texts, times in ((1, 3, 30), (2, sd.HELD + 1, 2), (3, sd.HELD, 4), (4, 40, 1), (5, 1, 50)) for t in range(texts) for place in range(times)]
    frame = pd.DataFrame({"t": [r[0] for r in rows], "open": True, "place": [r[2] for r in rows], "run": [r[1] for r in rows]})
    for size in (1, 2, 7, 20, len(frame)):
        out = pd.concat(list(sd._run_kinds(iter([frame[a : a + size].reset_index(drop=True) for a in range(0, len(frame), size)]))))
        often = out[out["partner"].isna()]
        assert often.groupby("run")["n"].agg(["sum", "size"]).to_dict("index") == {2: {"sum": sd.HELD + 1, "size": 2 * (sd.HELD + 1)}, 4: {"sum": 40, "size": 40}}
        rare = out[out["partner"].notna()]
        assert len(rare) == 3 * 2 + sd.HELD * (sd.HELD - 1) and rare["n"].sum() == 3 * 2 * 30 + sd.HELD * (sd.HELD - 1) * 4
