"""Sources."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The spellings of a missing field, and of the truth values.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUTHS = {"True": True, "TRUE": True, "true": True, "False": False, "FALSE": False, "false": False}
#: The kinds of a field as bits; a column's kind is their union over all rows.
BOOL, INT, FLOAT, TEXT = 1, 2, 4, 8


def _kind(field: Column) -> Column:
    """The bit of a field that is not missing: the narrowest kind that holds it."""
    plain = F.trim(field)
    number = plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") | F.lower(plain).rlike(r"^[+-]?inf(inity)?$")
    whole = plain.rlike(r"^[+-]?[0-9]{1,19}$") & plain.try_cast("bigint").isNotNull()
    return F.when(field.isin(list(TRUTHS)), BOOL).when(whole, INT).when(number, FLOAT).otherwise(TEXT)


def inferred_types(df: DataFrame) -> dict[str, str]:
    """The type of each text column, from all of its rows in one pass.

    int < float < text and bool < text; missing fields are below all, but a
    column of whole numbers with one is a double, as is one with nothing else.
    Truth values and numbers together are text.
    """
    aggregates = []
    for i, c in enumerate(df.columns):
        field = F.col(f"`{c}`")
        lacks = field.isNull() | field.isin(MISSING)
        aggregates += [F.bit_or(F.when(lacks, 0).otherwise(_kind(field))).alias(f"k{i}"), F.bool_or(lacks).alias(f"m{i}")]
    row = df.agg(*aggregates).first()
    types = {}
    for i, c in enumerate(df.columns):
        kinds, lacks = row[f"k{i}"] or 0, row[f"m{i}"]
        if kinds & TEXT or (kinds & BOOL and kinds & (INT | FLOAT)):
            types[c] = "string"
        elif kinds == BOOL:
            types[c] = "boolean"
        elif kinds == INT and not lacks:
            types[c] = "bigint"
        else:
            types[c] = "double"
    return types


def inferred_csv(spark: SparkSession, path: str, drop_index: bool = False) -> DataFrame:
    """A CSV with a header, its types inferred from every row; missing fields are null."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    columns = []
    for c, kind in inferred_types(raw).items():
        field = F.col(f"`{c}`")
        known = F.when(~field.isin(MISSING), field)
        if kind == "boolean":
            known = F.when(known.isin([k for k, v in TRUTHS.items() if v]), True).when(known.isNotNull(), False)
        elif kind != "string":
            known = F.trim(known).cast(kind)
        columns.append(known.alias(c))
    df = raw.select(*columns)
    return df.drop("Unnamed: 0", "_c0") if drop_index else df


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, drop_index: bool = False) -> DataFrame:
    """A CSV with a header; empty fields and NaN are null.  Without a schema the types are inferred from all rows.

    ``drop_index`` drops a first column without a name (an exported index).
    """
    if schema is None:
        return inferred_csv(spark, path, drop_index)
    df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
    return df.drop("Unnamed: 0", "_c0") if drop_index else df


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, x) of NPY arrays: the rows of each array, flattened."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                array = array.reshape(len(array), -1).astype(float)
                for at in range(0, len(array), 4096):
                    part = array[at : at + 4096]
                    yield pd.DataFrame({"file": name, "row": np.arange(at, at + len(part)), "x": list(part)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "file string, row bigint, x array<double>")


def image_folder(spark: SparkSession, folder: str, annotations: DataFrame, file_col: str, label_col: str,
                 transform: Column | None = None) -> DataFrame:
    """(file, label, content) of annotated files; ``transform`` maps ``content``."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = annotations.select(F.col(file_col).alias("file"), F.col(label_col).alias("label")).join(files, "file")
    return rows.withColumn("content", transform) if transform is not None else rows


def scaled_pixels(vector: str, top: float = 255.0) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / top)


def regression(spark: SparkSession, n: int, noise: float, low: float, high: float, truth, seed: int = 42) -> DataFrame:
    """(id, x, y) with y = truth(x) plus normal noise; ``truth`` maps a column."""
    x = F.rand(seed) * (high - low) + low
    return spark.range(n).withColumn("x", x).withColumn("y", truth(F.col("x")) + F.randn(seed + 1) * noise)


def classification(spark: SparkSession, n: int, features: int, share: float = 0.1, gap: float = 1.5, seed: int = 42) -> DataFrame:
    """(id, label, x) of two normal classes, the second with the given share."""
    base = spark.range(n).withColumn("label", (F.rand(seed) < share).cast("int"))
    return base.withColumn("x", F.array(*[F.randn(seed + 1 + i) + F.col("label") * gap for i in range(features)]))


def shuffled_batches(df: DataFrame, row_id: str, batch: int, seed: int = 42) -> DataFrame:
    """``batch_id``: rows dealt by a hash to batches of about the given size."""
    batches = max(1, round(df.count() / batch))
    return df.withColumn("batch_id", F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(batches)).cast("int"))
