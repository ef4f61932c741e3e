"""Shared scratch tables.

A written table cuts lineage and survives the loss of any executor. It lives in the folder
the cluster names in ``spark.checkpoint.dir``; only a local session without that setting
gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stormlift/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once and go on from the written table, in files of ``file_rows`` rows at most (0: a file a task)."""
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
