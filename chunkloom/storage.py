"""Reading tables and cutting lineage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_address() -> list[Column]:
    """The place of each row of a table read from Parquet files: unique, and the same in every scan."""
    return [F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session that runs in one process (tests) gets a folder in its warehouse; on a cluster, whose machines
    do not share such a folder, that is an error.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: later jobs do not repeat what led to them, and lost executors do no harm."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
