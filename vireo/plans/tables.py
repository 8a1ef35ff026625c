"""Tables and scratch space that every part of the engine shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "vireo-scratch")
    return f"{base.rstrip('/')}/vireo-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
