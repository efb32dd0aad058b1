"""License scans: an exact containment join of text blocks with templates.

Base places are phrases whose words stand consecutively.  The method proper is
a set-similarity join.  A template is a set of words; a text block (a line, cut
again at sentence ends) *contains* it when it holds at least
``ceil(threshold * |template|)`` of its distinct words.  A notice may also be
wrapped over lines: a sentence that goes on over line ends, up to a blank line,
is a block too, and contains a template when that many of its words stand in one
run of at most ``ceil(length / threshold)`` words, where ``length`` is the
template's own.  Words are ordered by their document frequency over the whole
corpus, rarest first, and

* prefix filter: a block that reaches the overlap ``need`` shares at least one
  of the template's ``|T| - need + 1`` rarest words, so only those are indexed;
* length filter: the block has at least ``need`` template words;
* positional filter: after the shared word at place i of the template and j of
  the block, at most ``min(|T| - i, |B| - j)`` further words can be shared;
* the survivors are verified by the exact overlap, wrapped ones in every run.

The filters drop no true pair, so the join is exact.  The index is broadcast:
its size is bounded by the template list, a parameter, and never by the data.

Nulls and empty texts count as no words.  Rows with equal ids keep a result
each; rows that are equal in id and text have equal results.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, split_words, text_or_empty

# The phrases counted as base places.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Short public license notices, label first.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Everything that is no word character, as a regex class.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Blocks end at line ends, and at sentence ends followed by white space.
BLOCK_ENDS = r"[\r\n]+|(?<=[.!?])[\x20\t]+"
#: Wrapped sentences end at sentence ends, and at lines that hold no word.
SENTENCE_ENDS = r"(?<=[.!?])[\x20\t\r\n]+|(?:\r\n?+|\n)[\x00-\x09\x0B\x0C\x0E-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+(?:\r\n?+|\n)"


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _all_template_words(text: str) -> list[str]:
    kept = "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text)
    return kept.split()


def _template_words(text: str) -> list[str]:
    return list(dict.fromkeys(_all_template_words(text)))


def _key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text_or_empty(text_col)).alias("_h"),
        text_or_empty(text_col).alias("_text"),
    )


def document_frequency(df: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """Over all documents, how many hold each word of ``vocabulary``.

    Only vocabulary words are shuffled and the result has one row for each.
    """
    known = F.array(*[F.lit(w) for w in vocabulary])
    counted = (
        df.select(F.explode(F.array_intersect(words(text_or_empty(text_col)), known)).alias("word"))
        .groupBy("word")
        .count()
    )
    return {r["word"]: r["count"] for r in counted.collect()}


def matching_blocks(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """Every (block, template) pair that meets the containment threshold.

    Columns: _id, _h (hash of the text, which tells rows with equal ids
    apart), block (from 0, wrapped sentences after the lines), template (from
    0), label, containment.
    """
    spark = df.sparkSession
    sets = [_template_words(t) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    seen = document_frequency(df, vocabulary, text_col)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index, least = [], 10**9
    for number, (own, (label, notice)) in enumerate(zip(sets, templates, strict=True)):
        ranks = sorted(rank[w] for w in own)
        need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        least = min(least, need)
        reach = math.ceil(len(_all_template_words(notice)) / threshold - 1e-9)
        index += [(r, place + 1, number, label, need, ranks, own, reach) for place, r in enumerate(ranks[: len(ranks) - need + 1])]
    rare = sorted({r[0] for r in index})
    index_df = spark.createDataFrame(
        index, "rank int, place int, template int, label string, need int, ranks array<int>, own_words array<string>, reach int"
    )
    rare_words = F.array(*[F.lit(order[r]) for r in rare])
    all_words = F.array(*[F.lit(w) for w in order])
    rare_ranks = F.array(*[F.lit(r) for r in rare])

    def ranked(block: Column) -> Column:
        shared = F.array_intersect(words(block), all_words)
        return F.array_sort(F.transform(shared, lambda w: (F.array_position(all_words, w) - 1).cast("int")))

    def run_overlap() -> Column:
        """Most template words in one run of ``reach`` words; it begins with one."""
        starts = F.filter(F.sequence(F.lit(1), F.size("_words")), lambda i: F.array_contains("own_words", F.element_at("_words", i)))
        return F.aggregate(starts, F.lit(0), lambda most, i: F.greatest(
            most, F.size(F.array_intersect(F.slice("_words", i, F.col("reach")), F.col("own_words")))))

    lines = F.transform(F.split("_text", BLOCK_ENDS), lambda b: F.struct(b.alias("b"), F.lit(False).alias("wrapped")))
    wrapped = F.transform(F.filter(F.split("_text", SENTENCE_ENDS), lambda b: b.rlike(r"[^\r\n][\r\n]+[^\r\n]")),
                          lambda b: F.struct(b.alias("b"), F.lit(True).alias("wrapped")))
    blocks = (
        _key(df, id_col, text_col)
        .filter(F.arrays_overlap(words(F.col("_text")), rare_words))
        .select("_id", "_h", F.posexplode(F.concat(lines, wrapped)).alias("block", "_b"))
        .select("_id", "_h", "block", F.col("_b.b").alias("_block"), F.col("_b.wrapped").alias("_wrapped"))
        .filter(F.arrays_overlap(words(F.col("_block")), rare_words))
        .select("_id", "_h", "block", "_block", "_wrapped", ranked(F.col("_block")).alias("own"))
        .filter(F.size("own") >= least)
        .select("_id", "_h", "block", "own", F.when(F.col("_wrapped"), words(F.col("_block"))).alias("_words"))
    )
    probes = blocks.select("*", F.explode(F.array_intersect("own", rare_ranks)).alias("rank"))
    at = F.array_position("own", F.col("rank"))
    return (
        probes.join(F.broadcast(index_df), "rank")
        .filter(F.size("own") >= F.col("need"))
        .filter(1 + F.least(F.size("ranks") - F.col("place"), F.size("own") - at) >= F.col("need"))
        .filter(F.size(F.array_intersect("ranks", "own")) >= F.col("need"))
        .select("_id", "_h", "block", "template", "label", "need", F.size("ranks").alias("whole"),
                F.when(F.col("_words").isNull(), F.size(F.array_intersect("ranks", "own"))).otherwise(run_overlap()).alias("overlap"))
        .filter("overlap >= need")
        .groupBy("_id", "_h", "block", "template", "label")
        .agg((F.max("overlap") / F.max("whole")).alias("containment"))
    )


def phrase_places(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """Per row: n_words, and ``places``, an array of (start, label)."""
    split = {tuple(p.split()): label for p, label in phrases.items()}
    firsts = F.array(*[F.lit(p[0]) for p in split])

    def starts(own: Column, phrase: tuple[str, ...], label: str) -> Column:
        last = F.size(own) - len(phrase)

        def here(i: Column) -> Column:
            same = own[i] == phrase[0]
            for k, w in enumerate(phrase[1:], 1):
                same = same & (own[i + k] == w)
            return same

        none = F.array().cast("array<struct<start:int,label:string>>")
        return F.when(
            (last >= 0) & F.array_contains(own, phrase[0]) & F.array_contains(own, phrase[-1]),
            F.transform(F.filter(F.sequence(F.lit(0), last), here),
                        lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))),
        ).otherwise(none)

    empty = F.array().cast("array<struct<start:int,label:string>>")
    per_row = let(
        words(F.col("_text")),
        lambda own: F.struct(
            F.size(own).cast("long").alias("n_words"),
            F.when(F.arrays_overlap(own, firsts),
                   F.concat(*[starts(own, p, label) for p, label in split.items()])).otherwise(empty).alias("places"),
        ),
    )
    return _key(df, id_col, text_col).select("_id", "_h", per_row.alias("r")).select("_id", "_h", "r.*")


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = 0.8,
) -> DataFrame:
    """Per row of ``df``: its id, n_words, places, found labels and score.

    ``found`` is the sorted set of labels of templates contained in some
    block; ``score`` is 1 where a phrase stands, else the best containment.
    """
    base = phrase_places(df, id_col, text_col, phrases)
    found = (
        matching_blocks(df, id_col, text_col, templates, threshold)
        .groupBy("_id", "_h")
        .agg(F.array_sort(F.collect_set("label")).alias("found"), F.max("containment").alias("best"))
    )
    b, f = base.alias("b"), found.alias("f")
    same = F.col("b._id").eqNullSafe(F.col("f._id")) & (F.col("b._h") == F.col("f._h"))
    return b.join(f, same, "left").select(
        F.col("b._id").alias(id_col),
        "n_words",
        "places",
        F.coalesce("found", F.array().cast("array<string>")).alias("found"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
