"""Sampling of a generative model: noise schedule, preconditioning, solver steps over arrays of a row.

The model's outputs come from a table; no weights are public.
"""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGMA_MIN, SIGMA_MAX, RHO, SIGMA_DATA = 0.002, 80.0, 7.0, 0.5


def sigma_at(i: Column, n: int) -> Column:
    """Noise level of step i of n."""
    low, high = SIGMA_MIN ** (1 / RHO), SIGMA_MAX ** (1 / RHO)
    return F.pow(i / float(n - 1) * (low - high) + high, F.lit(RHO))


def karras_sigmas(spark: SparkSession, n: int) -> DataFrame:
    """(step, sigma) of n falling levels and a last zero."""
    steps = spark.range(n + 1).withColumnRenamed("id", "step")
    return steps.withColumn("sigma", F.when(F.col("step") == n, 0.0).otherwise(sigma_at(F.col("step"), n)))


def sigmas(n: int) -> np.ndarray:
    low, high = SIGMA_MIN ** (1 / RHO), SIGMA_MAX ** (1 / RHO)
    return np.append((high + np.arange(n) / (n - 1) * (low - high)) ** RHO, 0.0)


def scaled_input(x, sigma):
    return x / (sigma**2 + SIGMA_DATA**2) ** 0.5


def noise_label(sigma: float) -> float:
    return math.atan(sigma / SIGMA_DATA)


def denoised(x, sigma, prediction):
    """The estimate of the clean sample from the model's output."""
    total = sigma**2 + SIGMA_DATA**2
    return SIGMA_DATA**2 / total * x + sigma * SIGMA_DATA / total**0.5 * prediction


def first_order(sample: Column, clean: Column, sigma: float, to: float) -> Column:
    """A solver step for arrays of a row."""
    r = to / sigma
    return F.zip_with(sample, clean, lambda x, y: x * r - y * (r - 1))


def second_order(sample: Column, clean: Column, clean_before: Column, sigma_before: float, sigma: float, to: float) -> Column:
    """A midpoint step for arrays of a row, from two estimates of the clean sample."""
    r = to / sigma
    h, h_before = math.log(sigma) - math.log(to), math.log(sigma_before) - math.log(sigma)
    clean = F.zip_with(clean, clean_before, lambda x, y: x + (x - y) * (0.5 * h / h_before))
    return F.zip_with(sample, clean, lambda x, y: x * r - y * (r - 1))


def solved(noise: Column, predictions: Column, steps: int) -> Column:
    """From noise to a sample, arrays of a row: midpoint steps down the schedule, the first and the last of first order.

    predictions: an array with the model's output for each step. The state of the fold is the sample
    and the last estimate of the clean one.
    """
    s = sigmas(steps).tolist()
    at = F.array(*[F.struct(
        F.lit(k).alias("k"), F.lit(s[k]).alias("sigma"), F.lit(s[k + 1] / s[k]).alias("r"),
        F.lit(0.0 if k in (0, steps - 1) else 0.5 * math.log(s[k] / s[k + 1]) / math.log(s[k - 1] / s[k])).alias("share"),
    ) for k in range(steps)])

    def step(held: Column, now: Column) -> Column:
        clean = F.zip_with(held["x"], F.get(predictions, now["k"]), lambda x, p: denoised(x, now["sigma"], p))
        ahead = F.zip_with(clean, held["before"], lambda m, b: m + (m - b) * now["share"])
        return F.struct(F.zip_with(held["x"], ahead, lambda x, m: x * now["r"] - m * (now["r"] - 1)).alias("x"), clean.alias("before"))

    start = F.struct(F.transform(noise, lambda x: x * s[0]).alias("x"), F.transform(noise, lambda x: x * 0.0).alias("before"))
    return F.aggregate(at, start, step, lambda held: held["x"])
