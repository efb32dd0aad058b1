from __future__ import annotations

import math
import re
import textwrap
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from fathomlake.llm import license_scan, queries
from fathomlake.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(text: str | None) -> tuple:
    own, places = words(text or ""), []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
    labels, best = {label for _, label in places}, 1.0 if places else 0.0
    for block in re.split(license_scan.BLOCK_ENDS, text or ""):
        held = set(words(block))
        for label, template in license_scan.TEMPLATES:
            whole = set(words(template))
            shared = len(whole & held)
            if shared >= math.ceil(0.8 * len(whole) - 1e-9):
                labels.add(label)
                best = max(best, shared / len(whole))
    starts = [i for i, _ in places]
    return (len(own), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), best)


def as_tuple(r) -> tuple:
    return tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))


def by_sql(folder: str) -> list[tuple]:
    con = duckdb.connect()
    path = Path(folder) / "documents.parquet"
    con.execute(f"create view documents as select * from read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    columns = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    return sorted(con.execute(f"select {columns} from ({queries.oracle_sql()['op10_licenses']})").fetchall(), key=str)


def test_query_equals_brute_force_on_all_documents(spark, sf_dir):
    texts = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op10_licenses(spark, sf_dir).collect()
    assert {r["doc_id"]: as_tuple(r) for r in rows} == {d: brute(t) for d, t in texts.items()}
    assert sorted(((r["doc_id"], *as_tuple(r)) for r in rows), key=str) == by_sql(sf_dir)


def test_edge_texts(spark, tmp_path):
    texts = [
        None, "", "\n\n", "Under the MIT-License! under THE mit license under the mit license", "cc by nc cc by nc",
        "CC BY-SA", "x " * 100_000 + "apache license version 2", "Licensed under the Apache License, Version 2.0.",
        "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met",
        "Licensed under the\nApache License", "éa mit under the mit licenseé",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("places", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op10_licenses(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: as_tuple(r) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}
    assert sorted(((r["doc_id"], *as_tuple(r)) for r in rows), key=str) == by_sql(str(tmp_path))
    assert license_scan.scan(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "CC BY-SA")] * 2 + [(None, "CC BY-SA"), (1, "b")], "doc_id long, text string")
    assert sorted(len(r["found"]) for r in license_scan.scan(twice).collect()) == [0, 1, 1, 1]


def test_wrapped_notices_are_found(spark):
    long = {label: text for label, text in license_scan.TEMPLATES if label in ("mit", "bsd", "gpl", "isc")}  # the last of each label
    rows, expected = [], {}
    for lead in ("", " * ", "# "):
        for end in ("\n", "\r\n"):
            for width in (40, 72, 80):
                for label, text in long.items():
                    notice = end.join(textwrap.wrap(text, width, initial_indent=lead, subsequent_indent=lead))
                    expected[len(rows)] = [label]
                    rows.append((len(rows), f"some code by someone{end}{lead}{end}{notice}{end}{lead}{end}and more of it"))
                    expected[len(rows)] = [label]
                    rows.append((len(rows), "a title of a few words " * 40 + end + notice + end + "and then the rest " * 40))
    for text in long.values():  # the same words, apart or in other paragraphs
        own = text.split()
        for between in ("\n\n", "\n" + "other words stand here " * 5 + "\n"):
            expected[len(rows)] = []
            rows.append((len(rows), between.join(" ".join(own[i : i + 6]) for i in range(0, len(own), 6))))
    found = {r["doc_id"]: r["found"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == expected
