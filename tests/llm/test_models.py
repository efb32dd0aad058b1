"""HTML extraction, language ID, SentencePiece, nearest neighbours, pipeline."""

from __future__ import annotations

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomlake.llm import html_extract, language_id, nearest, queries, sentencepiece_codec, simhash
from fathomlake.llm.common import table

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
    "<article><h1>Caf&eacute; &amp; bar</h1><p>One   line\nof  text.</p><!-- <p>no</p> --><p>A &lt;b&gt; <b>bold</b> word &#x41;.</p>"
    "<script>var x = '<p>no</p>';</script></article><div class='ad'>Buy now!</div><div class='comments'><p>I agree.</p></div>"
    "<footer>&copy; all rights</footer></body></html>"
)


def test_html_main_text(spark):
    pages = {1: PAGE, 2: None, 3: "", 4: "<<<", 5: "<p>" * 3000, 6: "plain"}
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in pages.items()], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[1] == "Café & bar\nOne line of text.\nA <b> bold word A."
    assert got[2] == got[3] == got[5] == ""
    assert got.keys() == pages.keys()
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_marginals_equal_enumeration():
    draw = np.random.default_rng(1)
    for _ in range(20):
        n = int(draw.integers(1, 9))
        parents = [-1, *[int(draw.integers(0, i)) for i in range(1, n)]]
        unary, pair = draw.normal(size=n).tolist(), draw.normal(size=(2, 2)).tolist()
        total, ones = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weight = math.exp(sum(u * v for u, v in zip(unary, y, strict=True)) + sum(pair[y[parents[i]]][y[i]] for i in range(1, n)))
            total, ones = total + weight, ones + weight * np.array(y)
        one, _, log_z = html_extract.marginals(unary, parents, pair)
        assert one == pytest.approx((ones / total).tolist()) and log_z == pytest.approx(math.log(total))


def test_language_held_out_accuracy(spark, sf_dir):
    rows = queries.op4_language(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"] and len(r["text"] or "") > 40 and r["lang_pred"] != "und"]
    assert len(rows) == 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_rows(spark):
    learn = [(i, t, lang) for i in range(30) for t, lang in (("the weather is good and the house is old", "en"), ("das wetter ist gut und das haus ist alt", "de"))]
    model = language_id.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    asked = {1: None, 2: "", 3: "123 !?", 4: "das haus", 5: "the house " * 200_000, 6: "é", 7: "漢字"}
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(list(asked.items()), "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "de" and got[5]["lang_pred"] == "en"
    assert got[6]["lang_pred"] in ("de", "en") and got[7]["lang_pred"] in ("de", "en")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.fit(empty) is None
    assert language_id.predict(spark.createDataFrame([(1, "a")], "doc_id long, text string"), None).first()["lang_pred"] == "und"


def test_codewords_lie_apart():
    for n in (2, 3, 5, 7, 12):
        code = language_id.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= code.shape[1] // 4 + (n == 2)


@pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no vocabulary file")
def test_sentencepiece_parity_and_round_trip(spark, sf_dir):
    import sentencepiece

    model = sentencepiece_codec.read_model(queries.TOKENIZER)
    reference = sentencepiece.SentencePieceProcessor(model_proto=model.raw)
    texts = {-1: None, -2: "", -3: " ", -4: "  two  spaces ", -5: "\U0001f600 க் tab\t\n", -6: "▁mark", -7: "word " * 50_000}
    texts |= {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", F.lit(1))
    coded = sentencepiece_codec.encode(df, model)
    back = {r["doc_id"]: r for r in sentencepiece_codec.decode(coded, model).collect()}
    for d, t in texts.items():
        assert back[d]["ids"] == reference.encode(t or ""), d
        if d != -6:
            assert back[d]["decoded"] and back[d]["text"] == (t or ""), d
    assert sentencepiece_codec.encode(df.limit(0), model).count() == 0


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(*fields: tuple) -> bytes:
    """A protobuf message of (number, value): integers, floats, bytes."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        elif isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def unigram_model(extra: dict[str, float], spaces: int) -> bytes:
    """A hand-made unigram model with byte fallback; ``spaces``: does it remove extra ones."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]]
    pieces += [(p, s, 1) for p, s in ({"▁": -3.0, **{c: -8.0 for c in "abcdefghijklmnopqrstuvwxyz"}} | extra).items()]
    fields = [(1, _message((1, p.encode()), (2, s), (3, kind))) for p, s, kind in pieces]
    return _message(*fields, (2, _message((3, 1), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, spaces), (5, 1))))


UNIGRAM = {"▁the": -2.0, "▁ca": -4.0, "t": -5.0, "▁cat": -4.5, "ca": -6.0, "▁sat": -4.0, "at": -5.5, "s": -7.5, "he": -6.0}
ODD_TEXTS = ["the cat sat", "", " ", "  the  cat ", "Cat é 漢 \U0001f600", "thecat▁sat", "▁", "a\tb\nc", "the cat " * 3000, "zzz"]


@pytest.mark.parametrize(("extra", "spaces", "independent"), [({}, 0, True), ({"the▁cat": -3.0}, 0, False), ({}, 1, False)])
def test_unigram_models_equal_the_reference(spark, extra, spaces, independent):
    import sentencepiece

    model = sentencepiece_codec.Model.parse(unigram_model(UNIGRAM | extra, spaces))
    assert model.model_type == sentencepiece_codec.UNIGRAM and model.words_are_independent == independent
    reference = sentencepiece.SentencePieceProcessor(model_proto=model.raw)
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, None, ODD_TEXTS[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("backend", F.lit(1)).withColumn("decoded", F.lit(2))
    for threads in (1, 4):
        back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, model, threads=threads), model).collect()
        assert len(back) == len(rows)
        for r in back:
            text = rows[r["doc_id"]][1] or ""
            assert r["ids"] == reference.encode(text), text
            assert r["text"] == reference.decode(r["ids"]) and r["decoded"] == (r["text"] == text)


def test_a_word_that_differs_takes_the_references_ids(monkeypatch):
    import sentencepiece

    model = sentencepiece_codec.Model.parse(unigram_model(UNIGRAM, 0))
    wrong = sentencepiece_codec.Model.parse(unigram_model(UNIGRAM | {"▁cat": -40.0}, 0))
    codec = sentencepiece_codec._Codec(model)
    codec.words = wrong.tokenizer(whole=False)
    ids, same, equal = codec.encode(["the cat", "the mat", "sat cat"])
    reference = sentencepiece.SentencePieceProcessor(model_proto=model.raw)
    assert ids == [reference.encode(t) for t in ("the cat", "the mat", "sat cat")]
    assert equal == [False, True, False] and same == [True] * 3


def brute_nearest(vectors: dict, queries_: list, k: int = 10) -> dict:
    return {q: sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)[:k] for q in queries_}


def test_nearest_recall_and_distances(spark, sf_dir):
    vectors = {r[0]: [float(x) for x in r[1]] for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()}
    asked = [i for i in vectors if i % 100 == 0]
    want, rows = brute_nearest(vectors, asked), queries.op9_nearest(spark, sf_dir).collect()
    hits = {(r["query_id"], r["vec_id"]) for r in rows}
    assert len(rows) == 10 * len(asked)
    assert sum((q, i) in hits for q in want for _, i in want[q]) >= 0.9 * len(rows)
    assert all(r["score"] == pytest.approx(math.dist(vectors[r["query_id"]], vectors[r["vec_id"]])) for r in rows)


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_over_many_shards_and_blocks(spark, clustered):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16)) * (8 if clustered else 0)
    data = {i: (centres[i % 12] + draw.normal(size=16)).tolist() for i in range(1500)}
    data |= {2000 + i: data[7] for i in range(300)}  # a hot vector
    df = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    asked = [i for i in data if i % 20 == 0]
    rows = nearest.search(df, df.filter("vec_id % 20 = 0"), shard_rows=100, block_rows=16).collect()
    want = brute_nearest(data, asked)
    assert len(rows) == 10 * len(asked) and len({(r["query_id"], r["rank"]) for r in rows}) == len(rows)
    # the hot vector's copies tie: what counts is the distance
    assert sum(r["score"] <= want[r["query_id"]][r["rank"] - 1][0] + 1e-9 for r in rows) >= 0.9 * len(rows)
    hot = [(r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 2020]
    assert sorted(hot) == list(enumerate([7, *range(2000, 2009)], 1))


def test_nearest_edge_rows(spark):
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    got = {}
    for r in nearest.search(df, df.filter("vec_id in (1, 3, 4)")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {1: [2, 3], 3: [1, 2]}  # ties to the smaller id
    assert nearest.search(df.limit(0), df).count() == 0 and nearest.search(df, df.limit(0)).count() == 0


def test_pipeline_stages_keep_what_they_should(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    letters = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\p{L}")).count()
    assert counts[1] == letters > counts[2] == counts[3] == counts[4] == counts[5]
    assert docs.filter("decoded").count() == counts[5]
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and letterless texts, copies, unknown sources, an extra column."""
    words = {"en": "the weather is good and the old house by the lake was sold to a friend of mine".split(),
             "de": "das wetter ist gut und das alte haus am see wurde an einen freund von mir verkauft".split()}
    draw = np.random.default_rng(6)
    texts = {(lang, i): " ".join(draw.choice(words[lang], 40)) + f" {lang}{i}" for lang in words for i in range(12)}
    rows = [(i if lang == "en" else 100 + i, t, lang, "src0" if i % 2 else None) for (lang, i), t in texts.items()]
    rows += [(None, texts["en", 0].replace("weather", "winter") + " a text of its own without an id " + str(i) * 30, "en", "src1") for i in range(2)]
    rows += [(7, " ".join(draw.choice(words["de"], 60)) + " under an id that is used", "de", "src9"), (50, texts["en", 3], "en", "src0")]
    odd = [(60, None, "en", "src0"), (61, "", None, None), (62, "123 ...", "en", "src0"), (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = tmp_path / "sf"
    full = [(*r, len(r[1] or "")) for r in rows + odd]
    spark.createDataFrame(full, schema).withColumn("lang_pred", F.lit("clash")).write.parquet(str(folder / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert all(r["decoded"] for r in got)
    kept = {r["doc_id"] for r in got}
    assert kept >= {7, None} and 50 not in kept and kept.isdisjoint({60, 61, 62})
    fps = simhash.components(spark.createDataFrame([(r[0], r[1]) for r in full], "doc_id long, text string").filter(F.col("text").rlike(r"\p{L}")))
    assert len(got) == fps.select("fp").distinct().count()  # no two of them are near here
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
