from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fathomlake.llm import pii, queries
from fathomlake.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text: str | None) -> list[str]:
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


TEXTS = [
    None, "", " ", "a@b.c_x@y.z abc@def@ghi.com a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111111111111", "+1 (555) 123-4567 +49 30 1234 +1234567890123456 +",
    "\U0001f600 mail é x.y+z@mail.example.org\U0001f600 and 10.0.0.1", "5500 0000 0000 0004 +12345678901 7.7.7.7", "..@..", "9" * 400 + "@" + "9" * 400,
]


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("_id", F.lit("x"))
    for row in pii.detect(df).collect():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in row["base"]] == brute(TEXTS[row["_id"]])
        for s in row["base"]:
            assert TEXTS[row["_id"]][s["start"] : s["end"]] == s["value"]


def test_query_equals_brute_force_on_all_documents(spark, sf_dir):
    texts = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op2_pii(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(base)
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in base)
        assert (r["spans"].split(",") if r["spans"] else [])[: len(base)] == base


def test_terms_that_disclose_an_entity_go(spark):
    rows = [(i, f"Zanzibarro wrote from joe@corp.com on day {i} about the weather") for i in range(6)]
    rows += [(i, f"the weather on day {i} was about as it was") for i in range(6, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert len(clean) == 200
    assert all("joe@corp.com" not in clean[i] and "Zanzibarro" not in clean[i] for i in range(6))
    assert all("weather" in t for t in clean.values())
    assert all(clean[i] == text for i, text in rows[6:])


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a@b.de"), (1, "a@b.de"), (None, "a@b.de")]])
def test_sanitise_keeps_rows_and_columns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hidden", F.lit(7))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r["text"] in (None, "[EMAIL]") and r["hidden"] == 7 for r in got)


def test_terms_go_wherever_they_stand_in_a_document_that_holds_the_entity(spark):
    far = "and all of it was about the weather of the day " * 30
    rows = [(i, f"Zanzibarro {far} joe@corp.com {far} éZanzi zanzibarro, {i}") for i in range(6)]
    rows += [(i, f"{far} éZanzi on day {i}") for i in range(6, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert {i: clean[i] for i in range(6)} == {i: f" {far} [EMAIL] {far} éZanzi , {i}" for i in range(6)}
    assert all(clean[i] == text for i, text in rows[6:])
    places = {r["_id"]: [(s["start"], s["end"]) for s in r["hidden"]] for r in pii.detect(df).collect()}
    assert all(places[i] == [(m.start(), m.end()) for m in re.finditer("zanzibarro", text.lower())] for i, text in rows)


def brute_hidden(rows: list[tuple], support: int = 2, soft: float = 0.8, hard: float = 0.95, elsewhere: int = 20) -> dict:
    """(start, end, remove) of the hidden places of each distinct text, by counting all pairs."""
    distinct = dict.fromkeys(t or "" for _, t in rows)

    def masked(text: str) -> str:
        return re.sub(PATTERNS["email"], lambda m: " " * len(m[0]), text)

    def words(text: str) -> set[str]:
        return set(re.findall(r"[^\W\d_]+", text.lower()))

    held = {}
    for row in distinct:
        held[row] = {(k, row[a:b]) for k, a, b in ((s.split(":")[0], *map(int, s.split(":")[1:])) for s in brute(row))}
    n, n_c, n_t, n_ct = len(distinct), {}, {}, {}
    for row, entities in held.items():
        for t in words(row):
            n_t[t] = n_t.get(t, 0) + 1
        for c in entities:
            n_c[c] = n_c.get(c, 0) + 1
            for t in words(masked(row)):
                n_ct[c, t] = n_ct.get((c, t), 0) + 1
    score = {
        (c, t): min(1.0, math.log(both * n / (n_c[c] * n_t[t])) / math.log(n / n_c[c]))
        for (c, t), both in n_ct.items() if both >= support and n_c[c] < n
    }
    out = {}
    for row, entities in held.items():
        best = {}
        for (c, t), s in score.items():
            if s >= soft and (c in entities or (s >= hard and n_ct[c, t] >= elsewhere)):
                best[t] = max(best.get(t, 0), s)
        out[row] = [(m.start(), m.end(), best[m[0].lower()] >= hard) for m in re.finditer(r"[^\W\d_]+", masked(row)) if m[0].lower() in best]
    return out


def test_hidden_terms_equal_brute_force_with_repeated_rows(spark):
    draw, names = random.Random(5), [f"name{c}" for c in "abcdefghij"]
    common = [f"word{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    rows: list[tuple] = []
    for i in range(400):
        words = draw.choices(common, k=30)
        if i % 4 == 0:
            who = draw.randrange(10)
            words += [f"{names[who]}@corp.org"] if draw.random() < 0.8 else ["10.0.0.7"]
            words.insert(draw.randrange(20), names[who].capitalize())
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"zorblax and john@acme.org {' '.join(draw.choices(common, k=15))}") for i in range(25)]
    rows += [(2000, "zorblax alone among " + " ".join(common[:5]))]
    rows += [rows[0]] * 30 + [rows[400]] * 30 + [(None, rows[4][1])] * 5 + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_hidden(rows)
    assert any(want.values()) and want[rows[425][1]][0][2]
    texts = {i: t for i, t in rows if i is not None}
    for r in pii.detect(df).collect():
        text = texts.get(r["_id"], rows[4][1] if r["hidden"] or r["base"] else "")
        assert [(s["start"], s["end"], s["remove"]) for s in r["hidden"]] == want.get(text, [])


def test_copies_lend_no_support(spark, sf_dir):
    text = "Zanzibarro and forty other rare words wrote from joe@corp.com on a sunny day"
    rows = [(i, text) for i in range(60)] + [(None, text)] * 60 + [(100 + i, f"the weather on day {i} was as it was") for i in range(60)]
    clean = [r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(clean) == sorted([text.replace("joe@corp.com", "[EMAIL]")] * 120 + [t for _, t in rows[120:]])
    documents = table(spark, sf_dir, "documents")
    twice = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10**9))
    hidden = {r["_id"]: r["hidden"] for r in pii.detect(documents).collect()}
    assert all(r["hidden"] == hidden[r["_id"] % 10**9] for r in pii.detect(twice).collect())


def test_work_grows_with_the_matches_of_a_text(spark):
    text = " ".join(f"mail{i}@host{i}.org +1 555 010 {i:04d}" for i in range(9000))
    df = spark.createDataFrame([(1, text), (2, "some words")], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean == {1: " ".join(["[EMAIL] [PHONE]"] * 9000), 2: "some words"}
