from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomlake.llm import conversations, queries

ROWS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def spaced(value) -> str:
    return " " if value is None else str(value)


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        fault, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def repair_by_all_strings(rows: list[tuple]) -> tuple[int, str, str]:
    """Cheapest (cost, audit), by the least pair of every suffix and state, with no walk."""

    @lru_cache(None)
    def best(i: int, q: str, room: int) -> tuple:
        """q: the initials so far, as far as the grammar needs them; room: insertions left before the next row."""
        options = []
        if i == len(rows) and q in ("", "a"):
            options.append((0, "", ()))
        nexts = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
        name = {"u": "user", "a": "assistant"}[nexts]
        if room:
            c, s, t = best(i, nexts, room - 1)
            options.append((c + 2, "I" + s, ((name, ""), *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, s, t = best(i + 1, q, 4)
            options.append((c + 3, "D" + s, t))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                c, s, t = best(i + 1, nexts, 4)
                options.append((c + 2 + extra, "R" + s, ((name, text), *t)))
                if role[:1] == nexts or (q == "" and role[:1] == "s"):
                    c, s, t = best(i + 1, role[:1], 4)
                    options.append((c + extra, "K" + s, ((role, text), *t)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "~", ())

    cost, audit, turns = best(0, "", 4)
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in turns))
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)


def brute(rows: list[tuple], convs: set) -> list[tuple]:
    out = []
    for conv in convs:
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in own:
            left = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, whole = repair_by_all_strings(marked)
        n = [sum(f == kind for _, _, f in marked) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=str)


def reported(rows, known) -> list[tuple]:
    return sorted((tuple(r) for r in conversations.report(rows, known).collect()), key=str)


def random_rows(draw: random.Random, n: int, convs: list) -> list[tuple]:
    texts = ["Fine.", "Fine.", "No end", " \t", "", None, "Why?\n", "Öh! ", "end...x", "a:b."]
    roles = ["user", "assistant", "system", "tool", "User", "", None, "ua", "user", "assistant"]
    return [(draw.choice(convs), draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts)) for _ in range(n)]


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf_dir}/conversations.parquet')")
    found = queries.op13_conversations(spark, sf_dir)
    ours = sorted((tuple(r) for r in found.collect()), key=str)
    theirs = con.execute(f"select {', '.join(found.columns)} from ({queries.oracle_sql()['op13_conversations']})").fetchall()
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert ours == sorted(theirs, key=str)
    assert ours == brute(damaged(rows), {r[0] for r in rows})


@pytest.mark.parametrize("seed", range(3))
def test_random_rows_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = random_rows(draw, 160, [None, *range(25), 7, 7])
    given = spark.createDataFrame(rows, ROWS).repartition(3)
    found = reported(conversations.damage(given), given)
    assert found == brute(damaged(rows), {r[0] for r in rows})


def test_sql_equals_the_query_on_rows_with_nulls_and_ties(spark, tmp_path):
    rows = random_rows(random.Random(11), 150, [None, *range(20)])
    given = spark.createDataFrame(rows, ROWS)
    given.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/c/*.parquet')")
    columns = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    theirs = con.execute(f"select {columns} from ({queries.oracle_sql()['op13_conversations']})").fetchall()
    assert reported(conversations.damage(given), given) == sorted(theirs, key=str)


def test_a_hot_conversation_is_cut_and_equals_the_whole(spark):
    draw = random.Random(4)
    rows = [(1, t, draw.choice(["user", "assistant", "assistant", "system", "tool"]), draw.choice(["Yes.", "No.", "x", f"t{t}.", f"t{t}", f"u{t}!"])) for t in range(400)]
    rows += [(c, t, r, f"{c}.") for c in (0, 2, 3) for t, r in enumerate(["user", "assistant"])]
    given = spark.createDataFrame(rows, ROWS).repartition(5)
    _, _, edits = conversations.plan(given)
    pieces = edits.groupBy("conv").count().collect()
    assert {r[0]: r[1] for r in pieces}[1] > 1  # several tasks share it
    import sys

    sys.setrecursionlimit(20_000)
    assert reported(given, given) == brute(rows, {0, 1, 2, 3})
    turns = conversations.repair(given).collect()
    for conv in (0, 1, 2, 3):
        own = sorted((r["place"], r["role"], r["text"]) for r in turns if r["conv_id"] == conv)
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert GRAMMAR.fullmatch("".join(r[0] for _, r, _ in own))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest()
        assert digest == next(r[-1] for r in brute(rows, {conv}))


@pytest.mark.parametrize("seed", range(4))
def test_pieces_walked_apart_equal_the_whole_walk(seed):
    draw = random.Random(seed)
    for _ in range(200):
        letters = "".join(draw.choices("suaoxSUAO", k=draw.randrange(1, 14)))
        whole, _ = conversations.walk(letters)
        cut = draw.randrange(len(letters) + 1)
        middle = tuple(c[0] for c in conversations.costs_to_go(letters[cut:]))
        left, state = conversations.walk(letters[:cut], 0, middle, False)
        assert left + conversations.walk(letters[cut:], state)[0] == whole
        assert conversations._cost(letters, whole) == conversations.costs_to_go(letters)[0][0]


def test_edge_rows(spark):
    long_text = "word " * 400_000 + "end."
    rows = [(1, 0, "user", long_text), (1, 1, "assistant", "ok."), (2, None, None, None), (2, None, None, None), (3, 5, "system", "s."),
            (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 9, "assistant", "x."), (None, 0, "user", "a.")]
    given = spark.createDataFrame(rows, ROWS).withColumn("conv", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("n", F.lit(2)).withColumn("_copy", F.lit(2))
    plain = [(c, t, spaced(r), spaced(x)) for c, t, r, x in rows]
    assert reported(given, given) == brute(plain, {1, 2, 3, 4, None})
    assert reported(given.filter("conv_id = 3"), given) == brute([r for r in plain if r[0] == 3], {1, 2, 3, 4, None})
    assert reported(given.limit(0), given.limit(0)) == []
    assert conversations.repair(given.limit(0)).collect() == []
    assert [tuple(r) for r in conversations.repair(given.filter("conv_id is null")).collect()] == [(None, 0, "user", "a."), (None, 1, "assistant", "")]
    named = given.filter("conv_id = 4").selectExpr("concat('c', conv_id) as conv_id", "turn", "role", "text")
    assert [r["conv_id"] for r in conversations.repair(named).collect()] == ["c4", "c4"]
