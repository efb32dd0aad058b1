"""From raw documents to mixed, tokenised training data, in stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.llm import language_id, mixing, pii, sentencepiece_codec, simhash
from fathomlake.llm.common import durable
from fathomlake.llm.queries import MIX_REST, MIX_WEIGHTS, TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language (no text, or no letter in it) go.

    An ambiguous prediction is no rejection: short and mixed texts stay.
    """
    docs = docs.select(*COLUMNS)  # others are no columns of documents
    marked = language_id.predict(docs, language_id.fit(docs), keep=tuple(COLUMNS[1:]))
    return marked.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with personal data and disclosing terms hidden."""
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, laid out in the order of the mixture."""
    return mixing.in_mixture_order(mixing.mix(docs, MIX_WEIGHTS, MIX_REST), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as token ids, in the order of the mixture."""
    coded = sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(TOKENIZER), keep=("lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if place == 0 else durable(docs), sf_dir)
    return docs


ORACLE_SQL = None
