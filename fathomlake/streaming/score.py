"""Structured Streaming: score a stream, and watch the scores in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scored(stream: DataFrame, prediction: Column, name: str = "prediction") -> DataFrame:
    """A fitted model's prediction is a column expression: no state, no Python."""
    return stream.withColumn(name, prediction)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows a window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None):
    """Start into an in-memory table (tests) with all that is available now."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
