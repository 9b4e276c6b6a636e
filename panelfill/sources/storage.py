"""Where intermediate tables go: the folder the session names, shared by the whole cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset a folder of the session's warehouse; every executor reaches both."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_panelfill"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the table to the shared folder and go on from the files.

    This cuts the lineage, computes the input once however often the result is read, survives lost executors,
    and keeps column pruning and filter pushdown for later readers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
