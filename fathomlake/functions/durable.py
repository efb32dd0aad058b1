"""Cutting the lineage of a DataFrame."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tables-")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir`` and read back.

    Where that is unset a temporary folder serves local mode; on a cluster it is
    an error.  A written table tells the optimizer its true size, so estimates
    do not grow with the rounds of a loop.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
