"""All registered queries, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, impute, logistic, metrics, scale, split
from . import evaluation, models, preparation, text  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES, finish, lines

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, split by class, scale, fit a classifier and report on the held-out part."""
    columns = ["quantity", "price", "discount", "tax"]
    data = clean.clean(lines(spark, sf_dir), {"quantity": (0, 50)}, columns, ["tax"], 3)
    data = data.withColumn("label", (F.col("l_returnflag") == "N").cast("int")).select("line_id", "label", *columns)
    parts = split.stratified_split(data, "line_id", "label", 0.2)
    train, held = parts.filter("not is_test"), parts.filter("is_test")
    stats = scale.moments(train, columns)
    train = impute.mean_impute(scale.zscore(train, columns, stats, 1e-8), columns)
    held = impute.mean_impute(scale.zscore(held, columns, stats, 1e-8), columns, train)
    model = logistic.fit(train, columns, "label", rate=0.5, rounds=10, class_weight="balanced")
    predicted = held.select("label", model.predict().alias("prediction"))
    return finish(metrics.class_report(metrics.confusion(predicted, "label", "prediction")))
