"""Model configuration, quantile tables and calibrations as JSON in any store that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

NUMBERS = ArrayType(DoubleType())
CONFIG = StructType([
    StructField("coarse_means", NUMBERS), StructField("coarse_stds", NUMBERS), StructField("cond_snr", NUMBERS), StructField("frequency_mult", NUMBERS),
    StructField("histogram_raw", NUMBERS), StructField("coarse_pooling", IntegerType()), StructField("latent_compression", IntegerType()), StructField("native_resolution", DoubleType()),
])
#: How many numbers each array holds.
LENGTHS = {"coarse_means": 6, "coarse_stds": 6, "cond_snr": 5, "frequency_mult": 5}
TABLES = StructType([
    StructField("n_quantiles", IntegerType()), StructField("data_quantile_tables", ArrayType(NUMBERS)),
    StructField("a_temp_std", DoubleType()), StructField("b_temp_std", DoubleType()), StructField("temp_std_p1", DoubleType()), StructField("temp_std_p99", DoubleType()),
])
CALIBRATION = StructType([StructField("peak_m", DoubleType()), StructField("land_cells", IntegerType()), StructField("half", IntegerType())])


def _one(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def problems(config: DataFrame) -> DataFrame:
    """Rows of model_configs() with what is wrong with each, an empty array if nothing."""
    found = [F.when(F.coalesce(F.size(c), F.lit(-1)) != n, f"{c} must hold {n} values") for c, n in LENGTHS.items()]
    found.append(F.when(F.size("histogram_raw").isNotNull() & (F.size("histogram_raw") >= 0) & (F.size("histogram_raw") != 5), "histogram_raw must hold 5 values"))
    found += [F.when(~F.coalesce(F.col(c) > 0, F.lit(False)), f"{c} must be positive") for c in ("coarse_pooling", "latent_compression", "native_resolution")]
    return config.withColumn("problems", F.filter(F.array(*found), lambda p: p.isNotNull()))


def model_configs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each configuration file under path, with its problems."""
    return problems(_one(spark, path, CONFIG))


def quantile_tables(spark: SparkSession, path: str) -> DataFrame:
    """(channel, place, value, and the constants) of the quantile tables in a file; a table of another length than n_quantiles is an error."""
    rows = _one(spark, path, TABLES).select("*", F.posexplode("data_quantile_tables").alias("channel", "table"))
    whole = F.when(F.size("table") == F.col("n_quantiles"), F.col("table")).otherwise(F.raise_error(F.concat(F.lit("quantile table of channel "), F.col("channel").cast("string"), F.lit(" has another length"))))
    return rows.withColumn("table", whole).select("channel", F.posexplode("table").alias("place", "value"), "a_temp_std", "b_temp_std", "temp_std_p1", "temp_std_p99")


def save_calibration(calibration: DataFrame, path: str) -> None:
    """One row (peak_m, land_cells, half) as JSON."""
    calibration.select("peak_m", "land_cells", "half").limit(1).coalesce(1).write.mode("overwrite").json(path)


def calibration(spark: SparkSession, path: str) -> float | None:
    """The stored peak, or None where nothing usable was stored."""
    try:
        row = spark.read.schema(CALIBRATION).json(path).where("peak_m > 1").head(1)
    except Exception as problem:  # a missing file has an error class of the session's own
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return None
    return row[0]["peak_m"] if row else None


def config_text(values: dict) -> str:
    """A configuration as JSON text, for writing with spark.createDataFrame(...).write.text."""
    return json.dumps({k: v for k, v in values.items() if k in {f.name for f in CONFIG}})
