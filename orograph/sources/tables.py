"""The driver's tables and the engine's views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions.seasons import total_days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar climate input: one site for each line item."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_quantity") - 15).alias("bio1"), (c("l_discount") * 10000).alias("bio4"),
        (c("l_extendedprice") / 25).alias("bio12"), (c("l_tax") * 1500).alias("bio15"), ((c("l_extendedprice") - 20000) / 15).alias("elev_m"),
        (c("l_discount") * 15).alias("slope"), total_days(c("l_shipdate").cast("timestamp")).alias("days"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice 50 wide: one cell for each part."""
    c = F.col
    return table(spark, sf_dir, "part").select(
        F.floor(c("p_partkey") / 50).cast("long").alias("i"), (c("p_partkey") % 50).cast("long").alias("j"),
        ((c("p_retailprice") - 920) * 50 + (c("p_size") - 25) * 20).alias("elev_m"), (c("p_size") - 15).cast("double").alias("temp_c"),
    )
