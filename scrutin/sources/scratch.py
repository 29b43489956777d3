"""Tables and files between the steps of a job, where the driver and all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name where the driver and all executors see it: under spark.checkpoint.dir, or a temporary one where
    that is unset and all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """df as a table in a scratch folder: lineage ends there, and partition numbers in it stay as they are."""
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
