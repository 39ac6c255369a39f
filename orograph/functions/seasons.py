"""Temperature and rain at a time of the year and day. Days are doubles; a year has 365.25 of them here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orograph.functions.climate import clamp, lit

SWING_PER_SIGMA, WET_PER_CV = 2.8284271, 1.4142136
YEAR_DAYS = 365.25


def total_days(ts: Column) -> Column:
    return F.unix_micros(ts) / 86_400_000_000.0


def cyclic_distance(a: float, b: Column, period: float) -> Column:
    """Signed shortest way from a to b around a circle."""
    return F.pmod(b - a + period * 1.5, lit(period)) - period / 2


def smoothstep(x: Column) -> Column:
    return x * x * (3 - x * 2)


def smootherstep(x: Column) -> Column:
    return x * x * x * (x * (x * 6 - 15) + 10)


def summer_weight(days: Column, southern: bool = False) -> Column:
    """0 at midwinter, 1 at midsummer."""
    month = F.pmod(days / YEAR_DAYS, lit(1)) * 12
    return smootherstep(F.abs(cyclic_distance(6.5 if southern else 0.5, month, 12.0)) / 6)


def seasonal_temperature(mean_c: Column, sigma_c: Column, rainfall: Column, days: Column, strength: float = 1.0, southern: bool = False) -> Column:
    """With the yearly swing and that of the day; rainfall is 0 to 1, dry air swings more."""
    swing = sigma_c * (SWING_PER_SIGMA * strength)
    hour = F.pmod(days, lit(1)) * 24
    phase = smoothstep(F.abs(cyclic_distance(4.0, hour, 24.0)) / 12)
    return mean_c - swing / 2 + swing * summer_weight(days, southern) + (phase - 0.5) * (18 - rainfall * 13)


def rainfall_factor(precip_cv: Column, days: Column, strength: float = 1.0, southern: bool = False) -> Column:
    return F.greatest(lit(0), precip_cv / 100 * (WET_PER_CV * strength) * (summer_weight(days, southern) * 2 - 1) + 1)


def seasonal_rainfall(rainfall: Column, precip_cv: Column, days: Column, strength: float = 1.0) -> Column:
    return clamp(rainfall * rainfall_factor(precip_cv, days, strength), 0, 1)
