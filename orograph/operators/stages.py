"""What surrounds a generative model's stages: conditioning, scaling, quantile tables. Arrays of a row and plain columns.

The model itself isn't here: its weights are no public data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.climate import damped_precip_std, lapse_corrected, lit, rescaled_temperature_std, signed_root
from orograph.operators.search import BIN, LEAST_BINS, at_or_below, quantile_rows

SIGMA_DATA = 0.5


def z_score(x: Column, mean: float, std: float) -> Column:
    """A channel in the model's unit."""
    return (x - mean) / std


def from_z_score(x: Column, mean: float, std: float) -> Column:
    """A model's sample back in the channel's unit."""
    return x / SIGMA_DATA * std + mean


def mixed(condition: Column, noise: Column, snr: float) -> Column:
    """A condition with as much noise as the signal-to-noise angle asks for."""
    t = math.atan(snr)
    return condition * math.cos(t) + noise * math.sin(t)


def towards_noise(sample: Column, noise: Column, t: float) -> Column:
    """A sample moved by the angle t to noise of the data's deviation."""
    return sample * math.cos(t) + noise * (math.sin(t) * SIGMA_DATA)


def below(high: Column, difference: Column) -> Column:
    """The channel that a model gives as its difference to another one."""
    return high - difference


def cold_tail(temp: Column, knee: float = 20.0, factor: float = 1.25) -> Column:
    """Temperatures with those up to the knee spread away from it."""
    return F.when(temp <= knee, (temp - knee) * factor + knee).otherwise(temp)


def concat_scales(sizes: list[int], shares: list[float] | None = None) -> list[float]:
    """Factors that let concatenated inputs of these sizes keep unit magnitude, weighed by shares."""
    shares = shares or [1.0] * len(sizes)
    whole = math.sqrt(sum(sizes) / sum(w * w for w in shares))
    return [whole * w / math.sqrt(n) for w, n in zip(shares, sizes, strict=True)]


def conditioning(cells: DataFrame, channels: list[str], weight: str, means: list[float], stds: list[float], histogram: list[float], scales: list[float]) -> DataFrame:
    """(wi, wj, vector) for every whole window of 4 x 4 cells (i, j): the 58 numbers that condition a finer stage.

    Six weighted channels are divided by their weight (0 where it is about 0) and brought to the model's
    unit; a value that isn't a number is 0. The vector holds 16 of the first channel, 16 of the second, the
    means of the other four over the window's middle 2 x 2 cells, 16 of the mask, the histogram (5), and
    the noise level, each part by its scale. A window is one group of 16 rows, none of it leaves the JVM.
    """
    w, place = F.col(weight), F.pmod("i", F.lit(4)) * 4 + F.pmod("j", F.lit(4))
    z = [z_score(F.when(w > 1e-6, F.col(c) / w).otherwise(0.0), m, d) for c, m, d in zip(channels, means, stds, strict=False)]
    z = [F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)).alias(f"z{k}") for k, x in enumerate(z)]
    rows = cells.select(F.floor(F.col("i") / 4).alias("wi"), F.floor(F.col("j") / 4).alias("wj"), place.alias("place"), *z)
    middle = [F.avg(F.when(F.col("place").isin(5, 6, 9, 10), F.col(f"z{k}"))).alias(f"m{k}") for k in range(2, len(channels))]
    held = rows.groupBy("wi", "wj").agg(F.array_sort(F.collect_list(F.struct("place", "z0", "z1"))).alias("held"), *middle).where(F.size("held") == 16)
    mask, noise = (1.0 - means[len(channels)]) / stds[len(channels)], -0.5 * math.sqrt(12.0)
    parts = [
        F.transform("held", lambda c: c["z0"] * scales[0]), F.transform("held", lambda c: c["z1"] * scales[1]), F.array(*[F.col(f"m{k}") * scales[2] for k in range(2, len(channels))]),
        F.array_repeat(lit(mask * scales[3]), 16), F.array(*[lit(h * scales[4]) for h in histogram]), F.array(lit(noise * scales[5])),
    ]
    return held.select("wi", "wj", F.concat(*parts).alias("vector"))


def strictly_increasing(table: Column) -> Column:
    """A quantile table (an array) whose ties rise by a tenth of its least positive step; 1e-10 if it has none."""
    n = F.size(table)
    steps = F.zip_with(F.slice(table, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(table, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    least = F.coalesce(F.array_min(F.filter(steps, lambda d: d > 0)), lit(1e-10)) * 0.1
    start = F.array().cast("array<double>")
    return F.aggregate(table, start, lambda held, x: F.concat(held, F.array(F.when((F.size(held) > 0) & (x <= F.element_at(held, -1)), F.element_at(held, -1) + least).otherwise(x))))


def repaired(tables: DataFrame, by: list[str], place: str = "place", value: str = "value") -> DataFrame:
    """Tables as rows (by, place, value) whose ties rise like those of strictly_increasing(); a table is one group, as its repair runs along it."""
    held = tables.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, value))).alias("_t"))
    fixed = held.select(*by, F.transform("_t", lambda r: r[place]).alias("_p"), strictly_increasing(F.transform("_t", lambda r: r[value])).alias("_v"))
    return fixed.select(*by, F.explode(F.arrays_zip("_p", "_v")).alias("r")).select(*by, F.col("r._p").alias(place), F.col("r._v").alias(value))


def stacked(rows: DataFrame, channels: list[str], keep: list[str], value: str = "value") -> DataFrame:
    """(keep, channel, value): the columns named as rows."""
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias(value)) for c in channels])).alias("_c")).select(*keep, "_c.*")


def fitted_tables(noise: DataFrame, data: DataFrame, channels: list[str], fractions: list[float]) -> DataFrame:
    """(channel, place, x, y): of each channel the quantiles of its noise, repaired, beside those of its data."""
    def held(rows: DataFrame) -> DataFrame:
        # counted before they are stacked, when no channel has to be worked out for it
        bins = max(LEAST_BINS, -(-rows.count() * len(channels) // BIN))
        return quantile_rows(stacked(rows, channels, []), "value", ["channel"], fractions, bins)

    xs = repaired(held(noise), ["channel"]).withColumnRenamed("value", "x")
    ys = held(data).withColumnRenamed("value", "y")
    return xs.join(ys, ["channel", "place"])


def distributed_as(noise: DataFrame, tables: DataFrame, channels: list[str], places: int) -> DataFrame:
    """noise with each channel brought to its data's distribution by its table of so many places at most.

    A table is as long as the fractions asked for, whatever the rows; so it goes to the rows, as two arrays, and a
    row's channels stay together: no exchange of the rows, and each noise is worked out once. Tables that grow with
    the rows are for asof.interpolated().
    """
    table = lambda c: F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.struct("x", "y"))))
    one = tables.agg(*[table(c).alias(f"_{c}") for c in channels])
    one = one.select(*[F.when(F.size(f"_{c}") > 0, F.struct(F.col(f"_{c}.x").alias("x"), F.col(f"_{c}.y").alias("y"))).alias(f"_{c}") for c in channels])
    out = noise.crossJoin(F.broadcast(one))
    mapped = {c: F.when(F.col(c).isNotNull(), lookup(F.col(c), F.col(f"_{c}.x"), F.col(f"_{c}.y"), places)) for c in channels}
    return out.withColumns(mapped).drop(*[f"_{c}" for c in channels])


def lookup(x: Column, xs: Column, ys: Column, most: int | None = None) -> Column:
    """Piecewise linear lookup in two arrays of one length, the end values beyond the ends; the bracket comes from one pass over the table, by halves if it is known to hold no more than most."""
    k = F.size(F.filter(xs, lambda t: t <= x)) if most is None else at_or_below(xs, x, most)
    x0, x1 = F.get(xs, k - 1), F.get(xs, k)
    y0, y1 = F.get(ys, k - 1), F.get(ys, k)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k >= F.size(xs), F.element_at(ys, -1)).otherwise((x - x0) / (x1 - x0) * (y1 - y0) + y0)


def quantile_map(cells: DataFrame, channels: list[str], noise_tables: dict[str, list[float]], data_tables: dict[str, list[float]]) -> DataFrame:
    """cells with each noise channel brought to the distribution of its data table."""
    table = lambda held, c: F.array(*map(lit, held[c]))
    return cells.withColumns({c: lookup(F.col(c), table(noise_tables, c), table(data_tables, c)) for c in channels})


def synthetic_map(cells: DataFrame, a: float, b: float, p1: float, p99: float) -> DataFrame:
    """cells (elev, temp, temp_std, precip, precip_std) of independent channels made consistent, each column computed once.

    Temperature falls with height, its deviation follows it, that of rain fades where much falls;
    elevation becomes its signed root.
    """
    out = cells.withColumn("temp", lapse_corrected(F.col("temp"), F.col("precip"), F.col("elev")))
    out = out.withColumn("temp_std", rescaled_temperature_std(F.col("temp_std"), F.col("temp"), a, b, p1, p99))
    return out.withColumn("precip_std", damped_precip_std(F.col("precip_std"), F.col("precip"))).withColumn("elev", signed_root(F.col("elev")))
