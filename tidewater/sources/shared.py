"""Tables in the shared folder of a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, one of this machine's, but only for a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return f"{base.rstrip('/')}/tidewater-{uuid.uuid4().hex}"


def written(df: DataFrame, place: str | None = None) -> DataFrame:
    """The same rows from a table that was written: what is used many times is worked out once."""
    path = place or folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
