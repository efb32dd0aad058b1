"""Experiment tracking and a model registry as Parquet tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMAS = {
    "runs": "experiment string, run_id string, name string, started timestamp",
    "params": "run_id string, key string, value string",
    "metrics": "run_id string, key string, step int, value double",
    "artifacts": "run_id string, key string, content string",
    "tags": "run_id string, key string, value string",
    "registry": "model string, version int, run_id string, stage string",
    "aliases": "model string, alias string, version int, changed timestamp",
}


class Tracker:
    """Appends to tables below a folder; every value is a row."""

    def __init__(self, spark: SparkSession, folder: str, experiment: str = "default"):
        self.spark, self.folder, self.experiment = spark, folder, experiment

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMAS[name])

    def start(self, run_id: str, name: str, started) -> None:
        self._append("runs", [(self.experiment, run_id, name, started)])

    def params(self, run_id: str, values: Mapping) -> None:
        self._append("params", [(run_id, k, str(v)) for k, v in values.items()])

    def metrics(self, run_id: str, values: Mapping[str, float], step: int = 0) -> None:
        self._append("metrics", [(run_id, k, step, float(v)) for k, v in values.items()])

    def tag(self, run_id: str, values: Mapping) -> None:
        self._append("tags", [(run_id, k, str(v)) for k, v in values.items()])

    def artifact(self, run_id: str, key: str, content) -> None:
        """Any JSON value: a signature, a table of scores, model parameters."""
        self._append("artifacts", [(run_id, key, json.dumps(content))])

    def register(self, model: str, run_id: str, stage: str = "none") -> int:
        """The new version: one more than the largest."""
        top = self.table("registry").filter(F.col("model") == model).agg(F.max("version")).first()[0] or 0
        self._append("registry", [(model, top + 1, run_id, stage)])
        return top + 1

    def set_alias(self, model: str, alias: str, version: int, changed) -> None:
        self._append("aliases", [(model, alias, version, changed)])

    def by_alias(self, model: str, alias: str) -> int | None:
        rows = self.table("aliases").filter((F.col("model") == model) & (F.col("alias") == alias))
        return rows.agg(F.max_by("version", "changed")).first()[0]

    def copy(self, model: str, version: int, to: str) -> int:
        run = self.table("registry").filter((F.col("model") == model) & (F.col("version") == version)).first()["run_id"]
        return self.register(to, run)


def latest_versions(registry: DataFrame) -> DataFrame:
    """model, version, run_id of the largest version of each model."""
    return registry.groupBy("model").agg(F.max("version").alias("version"), F.max_by("run_id", "version").alias("run_id"))


def current_aliases(aliases: DataFrame) -> DataFrame:
    """model, alias, version: what each alias stands for now."""
    return aliases.groupBy("model", "alias").agg(F.max_by("version", "changed").alias("version"))


def best_runs(metrics: DataFrame, key: str, k: int) -> DataFrame:
    """The k runs with the largest last value of a metric."""
    last = metrics.filter(F.col("key") == key).groupBy("run_id").agg(F.max_by("value", "step").alias("value"))
    return last.orderBy(F.desc("value"), "run_id").limit(k)


def history(metrics: DataFrame, key: str) -> DataFrame:
    """run_id, step, value and the best value so far."""
    over = Window.partitionBy("run_id").orderBy("step")
    return metrics.filter(F.col("key") == key).select("run_id", "step", "value", F.max("value").over(over).alias("best"))
