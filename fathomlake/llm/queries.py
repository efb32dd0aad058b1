"""The registered queries of the corpus operators, one for each.

A query applies its operator with production parameters to the whole table and
derives the columns it returns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversations,
    decontaminate,
    fingerprints,
    html_extract,
    language_id,
    lexical_search,
    license_scan,
    mixing,
    nearest,
    oracles,
    pii,
    sentencepiece_codec,
    simhash,
    substring_dedup,
)
from .common import table

# The target weights of the mixture; other sources share ``*``.
MIX_WEIGHTS = {"src0": 10, "src1": 10, "src2": 8, "src3": 8, "src4": 6, "src5": 6, "src6": 4, "src7": 4}
MIX_REST = 44
#: The vocabulary file; any SentencePiece model will do.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _joined(items: Column) -> Column:
    return F.array_join(items, ",")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))

    def span(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    base = F.transform("base", span)
    hidden = F.transform("hidden", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("_id").alias("doc_id"),
        *[number(k) for k in pii.KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, hidden)).alias("spans"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"),
        fingerprints.resemblance(own, following).alias("near_next"),
        fingerprints.distinct_shingles(own).alias("n_shingles"),
        fingerprints.distinct_shingles(fingerprints.merge(own, following)).alias("n_shingles_with_next"),
        fingerprints.containment(own, edited).alias("inside_edited"),
        fingerprints.containment(edited, own).alias("edited_inside"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id"))
    model = language_id.fit(documents.filter("not held_out"))
    return language_id.predict(documents, model, keep=("held_out",))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))
    mixed = mixing.mix(documents, MIX_WEIGHTS, MIX_REST)
    return mixed.select(
        "doc_id",
        "source",
        "n_chars",
        F.col("_mix_source").alias("mix_source"),
        F.col("_block").alias("block"),
        F.col("_release").alias("release"),
        F.col("_deadline").alias("deadline"),
        F.col("_slot").alias("slot"),
        F.col("_row").cast("long").alias("row_in_block"),
    )


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select(
        F.col("doc").alias("doc_id"),
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("partner").alias("other_doc_id"),
        "identity",
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.read_model(TOKENIZER)
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded", "backend")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    labels = F.transform("places", lambda p: p["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _joined(F.array_sort(F.array_distinct(labels))).alias("base_labels"),
        _joined(F.array_sort(F.array_union(labels, F.col("found")))).alias("labels"),
        "score",
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(_joined(F.col("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(rows), rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_pii": op2_pii,
        "op3_fingerprints": op3_fingerprints,
        "op4_language": op4_language,
        "op5_simhash": op5_simhash,
        "op6_mixing": op6_mixing,
        "op7_substrings": op7_substrings,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_nearest": op9_nearest,
        "op10_licenses": op10_licenses,
        "op11_decontaminate": op11_decontaminate,
        "op12_lexical": op12_lexical,
        "op13_conversations": op13_conversations,
    }


def oracle_sql() -> dict[str, str]:
    """Models, sketches and Spark's hashes have no SQL; the others have."""
    return {"op10_licenses": oracles.op10_licenses(), "op11_decontaminate": oracles.op11_decontaminate(), "op12_lexical": oracles.op12_lexical(),
            "op13_conversations": oracles.op13_conversations()}
