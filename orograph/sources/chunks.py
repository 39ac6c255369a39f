"""Rows by chunk as Parquet that can be written again: a run replaces the chunks that it brings, and no other."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_chunks(rows: DataFrame, path: str, chunk: list[str], order: list[str]) -> None:
    """rows in a folder for each chunk, sorted within; chunks that rows doesn't hold stay as they are.

    A chunk is written by one task, so that its file is whole or absent; a run that is repeated
    after a failure leaves the same files.
    """
    placed = rows.repartition(*chunk).sortWithinPartitions(*chunk, *order)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*chunk).parquet(path)


def read_chunks(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The chunks that a condition on their columns names, without a look at others' files."""
    rows = spark.read.parquet(path)
    return rows.where(where) if where else rows


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; a local one in local mode only, where none is set."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
