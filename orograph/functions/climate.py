"""Bioclimatic column functions: evapotranspiration, moisture, seasons of growth, cover, rainfall bytes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Amplitude of a sine per standard deviation, as the growing season and the extreme months take it.
GROWING_AMPLITUDE, SEASONAL_AMPLITUDE = 1.414, 1.4142136
#: Knots (from, to, cover at from, cover at to) of the piecewise linear covers.
FOREST_KNOTS = ((0.2, 0.5, 0.05, 0.30), (0.5, 0.8, 0.30, 0.58), (0.8, 1.3, 0.58, 0.82), (1.3, 2.0, 0.82, 1.0))
SHRUB_KNOTS = ((0.08, 0.45, 0.05, 0.65), (0.45, 1.0, 0.65, 0.25), (1.0, math.inf, 0.25, 0.25))
#: Coefficients of the rational Chebyshev approximation of erfc, by rising power.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(lit(low), F.least(lit(high), x))


def sigma(seasonality: Column) -> Column:
    """Standard deviation of temperature from seasonality in hundredths."""
    return F.greatest(lit(0), seasonality) / 100


def potential_evapotranspiration(mean_c: Column, sigma_c: Column) -> Column:
    e = F.greatest(lit(0), mean_c + sigma_c * 0.5)
    return F.greatest(lit(250), e * 25 + e * e * 0.7 + 250)


def aridity(precip_mm: Column, pet_mm: Column) -> Column:
    return precip_mm / F.greatest(lit(1), pet_mm)


def tree_moisture(aridity_index: Column, precip_cv: Column) -> Column:
    return aridity_index * (1 - F.least(lit(1), precip_cv / 100) * 0.35)


def days_above(threshold: float, mean_c: Column, sigma_c: Column) -> Column:
    """Days a year above a temperature that follows a sine of this mean and standard deviation."""
    amplitude = sigma_c * GROWING_AMPLITUDE
    x = (lit(threshold) - mean_c) / F.when(amplitude >= 0.1, amplitude)
    wave = F.when(x <= -1, 365.0).when(x >= 1, 0.0).otherwise((0.5 - F.asin(clamp(x, -1, 1)) / math.pi) * 365)
    return F.when(amplitude < 0.1, F.when(mean_c > threshold, 365.0).otherwise(0.0)).otherwise(wave)


def effective_moisture(moisture: Column, growing_days: Column) -> Column:
    return moisture * clamp((growing_days - 60) / 90, 0, 1)


def bare_slope_threshold(moisture: Column) -> Column:
    return clamp((moisture - 0.35) / 0.45, 0, 1) * 0.49 + 0.7


def piecewise(x: Column, knots) -> Column:
    """Linear between knots, 0 below the first, the last value above the last."""
    pieces = [(upto, (x - low) / (upto - low) * (b - a) + a if upto != math.inf else lit(a)) for low, upto, a, b in knots]
    out = F.when(x < knots[0][0], 0.0)
    out = reduce(lambda c, p: c.when(x < p[0], p[1]) if p[0] != math.inf else c, pieces, out)
    return out.otherwise(lit(knots[-1][3]))


def forest_density(moisture: Column) -> Column:
    return piecewise(moisture, FOREST_KNOTS)


def shrub_density(moisture: Column) -> Column:
    return piecewise(moisture, SHRUB_KNOTS)


def permanent_ice(warmest_c: Column, precip_mm: Column) -> Column:
    return (warmest_c < 0) & (precip_mm > 150)


def cover_class(moisture: Column) -> Column:
    """Vegetation band of effective moisture."""
    return F.when(moisture < 0.2, "none").when(moisture < 0.5, "sparse").when(moisture < 0.8, "forest").when(moisture < 1.3, "dense").otherwise("rainforest")


def bioclim(mean_c: Column, seasonality: Column, precip_mm: Column, precip_cv: Column) -> Column:
    """A struct of everything that follows from the four climate variables."""
    s = sigma(seasonality)
    pet = potential_evapotranspiration(mean_c, s)
    ai = aridity(precip_mm, pet)
    moisture = tree_moisture(ai, precip_cv)
    growing = days_above(5, mean_c, s)
    effective = effective_moisture(moisture, growing)
    warmest = mean_c + s * SEASONAL_AMPLITUDE
    return F.struct(
        s.alias("sigma_c"), pet.alias("pet_mm"), ai.alias("aridity"), moisture.alias("tree_moisture"), growing.alias("growing_days"),
        (mean_c - s * SEASONAL_AMPLITUDE).alias("coldest_c"), warmest.alias("warmest_c"), effective.alias("effective_moisture"),
        bare_slope_threshold(moisture).alias("bare_slope"), forest_density(effective).alias("forest"), shrub_density(effective).alias("shrub"),
        permanent_ice(warmest, precip_mm).alias("ice"),
    )


def with_bioclim(df: DataFrame, mean_c: str, seasonality: str, precip_mm: str, precip_cv: str) -> DataFrame:
    """df with the struct b, as bioclim() gives it; its parts are worked out in steps, each once a row."""
    mean, rain = F.col(mean_c), F.col(precip_mm)
    out = df.withColumn("_sigma", sigma(F.col(seasonality)))
    out = out.withColumns({"_pet": potential_evapotranspiration(mean, F.col("_sigma")), "_growing": days_above(5, mean, F.col("_sigma"))})
    out = out.withColumn("_aridity", aridity(rain, F.col("_pet")))
    out = out.withColumn("_moisture", tree_moisture(F.col("_aridity"), F.col(precip_cv)))
    out = out.withColumn("_effective", effective_moisture(F.col("_moisture"), F.col("_growing")))
    warmest = mean + F.col("_sigma") * SEASONAL_AMPLITUDE
    b = F.struct(
        F.col("_sigma").alias("sigma_c"), F.col("_pet").alias("pet_mm"), F.col("_aridity").alias("aridity"), F.col("_moisture").alias("tree_moisture"),
        F.col("_growing").alias("growing_days"), (mean - F.col("_sigma") * SEASONAL_AMPLITUDE).alias("coldest_c"), warmest.alias("warmest_c"),
        F.col("_effective").alias("effective_moisture"), bare_slope_threshold(F.col("_moisture")).alias("bare_slope"),
        forest_density(F.col("_effective")).alias("forest"), shrub_density(F.col("_effective")).alias("shrub"), permanent_ice(warmest, rain).alias("ice"),
    )
    return out.withColumn("b", b).drop("_sigma", "_pet", "_growing", "_aridity", "_moisture", "_effective")


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1 / (z * 0.5 + 1)
    poly = reduce(lambda acc, c: acc * t + c, reversed(ERFC[:-1]), lit(ERFC[-1]))
    r = t * F.exp(poly - z * z)
    return F.when(x >= 0, r).otherwise(2 - r)


def normal_cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2)) * 0.5


def rainfall_byte(value: Column, median: float = 0.62, spread: float = 1.0, bias: float = 0.05) -> Column:
    """0 to 255 from the log-normal rank of a moisture (or millimetres), half to even."""
    z = (F.log(F.greatest(lit(1e-4), value)) - math.log(median)) / max(0.05, spread)
    return F.bround(clamp((normal_cdf(z) + bias) * 255, 0, 255), 0).cast("int")


def world_temperature(mean_c: Column, multiplier: float = 1.0, offset: float = 0.0) -> Column:
    return mean_c * multiplier + offset


def lapse_corrected(temp_c: Column, precip_mm: Column, elev_m: Column) -> Column:
    """Synthetic temperature brought from sea level to its elevation, by a lapse that moisture softens."""
    lapse = clamp(precip_mm * 0.0015 - 6.5, -9.8, -4.0) / 1000
    return clamp(temp_c + lapse * F.greatest(lit(0), elev_m), -10, 40)


def rescaled_temperature_std(std: Column, temp_c: Column, a: float, b: float, p1: float, p99: float) -> Column:
    base = temp_c * a + b
    u = (std - p1) / (p99 - p1)
    low = F.greatest(lit(p1), -base)
    return F.greatest(lit(20), u * (p99 - low) + low + base)


def damped_precip_std(std: Column, precip_mm: Column) -> Column:
    return std * F.greatest(lit(0), (185 - precip_mm * 0.04111) / 185)


def signed_square(x: Column) -> Column:
    return F.signum(x) * x * x


def signed_root(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def interp(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear lookup, the end values beyond the ends; one branch for each knot."""
    out = F.when(x <= xs[0], lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        if x1 > x0:
            out = out.when(x <= x1, (x - x0) / (x1 - x0) * (y1 - y0) + y0)
    return out.otherwise(lit(ys[-1]))
