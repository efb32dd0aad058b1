"""Sinks: predictions as CSV, models as JSON in a one-row Parquet table."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def posterior_columns(df: DataFrame, probabilities: str, classes: Sequence, prefix: str = "class_") -> DataFrame:
    """A column a class from an array of probabilities."""
    return df.withColumns({f"{prefix}{c}": F.col(probabilities)[i] for i, c in enumerate(classes)}).drop(probabilities)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _plain(value):
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _back(value):
    if isinstance(value, dict) and set(value) == {"array"}:
        return np.array(value["array"])
    return value


def save_model(spark: SparkSession, model, path: str) -> None:
    """A fitted model (a dataclass) as one row: type name and JSON parameters."""
    fields = {f.name: _plain(getattr(model, f.name)) for f in dataclasses.fields(model)}
    spark.createDataFrame([(type(model).__name__, json.dumps(fields))], "kind string, parameters string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, kind: type, path: str):
    row = spark.read.parquet(path).first()
    if row["kind"] != kind.__name__:
        raise ValueError(f"{path} holds a {row['kind']}, not a {kind.__name__}")
    fields = json.loads(row["parameters"])
    values = {}
    for f in dataclasses.fields(kind):
        value = _back(fields[f.name])
        if isinstance(value, list):
            value = [_back(v) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for v in value]
            value = value if "list" in str(f.type) else tuple(value)
        values[f.name] = value
    return kind(**values)
