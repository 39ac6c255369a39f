"""Elevation to height, packed map values, altitude bands."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orograph.functions.climate import clamp, lit

#: Bytes a degree of the temperature scale, and the elevations and depths that the model reaches.
DEGREE_BYTES = 4.25
MAX_ELEVATION_M, MAX_DEPTH_M = 10_000.0, 10_000.0


@dataclass(frozen=True)
class HeightMap:
    """Metres to block heights: linear to a knee, then bending towards the ceiling; a root curve below the sea."""

    height: int = 256
    sea_level: int = 110
    metres_per_block: float = 15.0
    exaggeration: float = 1.0
    mode: str = "isotropic"
    manual_metres_per_block: float = 0.0
    peak_m: float | None = None
    fill: float = 0.92
    knee_fraction: float = 0.85
    ocean_fraction: float = 0.9
    least_auto: float = 1.0
    most_auto: float = 20.0

    @property
    def headroom(self) -> int:
        return max(8, self.height - 3 - self.sea_level)

    @property
    def blocks_per_metre(self) -> float:
        true = 1 / self.metres_per_block
        if self.peak_m is not None and self.peak_m > 1 and math.isfinite(self.peak_m):
            wanted = self.fill * self.headroom / self.peak_m * self.metres_per_block
            return self.exaggeration * min(max(wanted, self.least_auto), self.most_auto) * true
        if self.mode == "manual" and self.manual_metres_per_block > 0:
            return self.exaggeration / self.manual_metres_per_block
        return self.exaggeration * true

    @property
    def knee(self) -> float:
        fits = MAX_ELEVATION_M * self.blocks_per_metre <= self.headroom
        return float(self.headroom) if fits else self.headroom * self.knee_fraction

    @property
    def ocean_scale(self) -> float:
        return self.ocean_fraction * max(8, self.sea_level - 4) / (math.sqrt(MAX_DEPTH_M + 10) - math.sqrt(10) + 1)

    def block_y(self, elev_m: Column, blocks_per_metre: Column | None = None) -> Column:
        """Height of the surface; blocks_per_metre: measured in the plan, instead of this map's own."""
        if blocks_per_metre is None:
            linear, knee, span = elev_m * self.blocks_per_metre, lit(self.knee), lit(max(1.0, self.headroom - self.knee))
        else:
            linear, fits = elev_m * blocks_per_metre, blocks_per_metre * MAX_ELEVATION_M <= self.headroom
            knee = F.when(fits, lit(self.headroom)).otherwise(self.headroom * self.knee_fraction)
            span = F.greatest(lit(1), self.headroom - knee)
        u = (linear - knee) / span
        land = F.when(linear <= knee, linear).otherwise(u / (u + 1) * span + knee).cast("int") + self.sea_level
        depth = (F.sqrt(F.greatest(lit(0), -elev_m) + 10) - math.sqrt(10) + 1) * self.ocean_scale
        return F.when(elev_m >= 0, land).otherwise(F.greatest(F.lit(2), self.sea_level - depth.cast("int")))

    def too_short(self, elev_m: Column) -> Column:
        """Whether ground at true scale would reach above the headroom."""
        return elev_m * self.blocks_per_metre > self.headroom

    def temperature_ceiling_m(self, temp_c: Column) -> Column:
        """Highest ground whose temperature still fits the climate byte."""
        return F.greatest(lit(0), (255 - (temp_c + 20) * DEGREE_BYTES) * 1.5) / self.blocks_per_metre


def described(h: HeightMap) -> str:
    """A height map in words."""
    if h.peak_m:
        shape = f"calibrated to a peak of {h.peak_m:.0f} m"
    else:
        shape = "true to scale" if h.mode == "isotropic" else f"exaggerated {h.exaggeration:g} times"
    return f"heights {shape}, {h.metres_per_block:g} m a block, sea level {h.sea_level}, world height {h.height}, headroom {h.headroom} blocks"


def pack_climate(temp_c: Column, rainfall: Column, surface_y: Column, sea_level: int) -> Column:
    """temperature << 16 | rainfall << 8, both with the height correction that readers undo."""
    top = F.greatest(surface_y, F.lit(sea_level - 1))
    above = top - sea_level
    temperature = F.bround((temp_c + 20) * DEGREE_BYTES + above / 1.5, 0).cast("int")
    half = F.when(above < 0, -F.floor(-above / 2)).otherwise(F.floor(above / 2)).cast("int")  # towards zero
    coast = F.greatest(F.lit(0), F.least(F.lit(8), 8 + sea_level - top)) * 5
    wet = rainfall - half - coast
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("int")
    return F.shiftleft(byte(temperature), 16).bitwiseOR(F.shiftleft(byte(wet), 8))


def unpack(packed: Column) -> tuple[Column, Column, Column]:
    """The three bytes of a packed value, highest first."""
    return tuple(F.shiftright(packed, s).bitwiseAND(255) for s in (16, 8, 0))


def pack_seasonality(sigma_c: Column, precip_cv: Column) -> Column:
    byte = lambda x: clamp(F.bround(x, 0), 0, 255).cast("int")
    return F.shiftleft(byte(sigma_c * 8), 16).bitwiseOR(F.shiftleft(byte(precip_cv), 8))


def cover_byte(density: Column, elev_m: Column, slope: Column, bare_slope: Column, multiplier: float = 1.0, variation: Column | None = None, amplitude: float = 0.18) -> Column:
    """0 to 255 of forest or shrub; none at sea or on slopes too steep for soil."""
    d = density * multiplier
    d = d + variation * amplitude * d if variation is not None else d
    return F.when((elev_m <= 0) | (slope >= bare_slope), 0).otherwise(clamp(F.bround(d * 255, 0), 0, 255).cast("int"))


def ocean_byte(elev_m: Column) -> Column:
    return F.when(elev_m >= 0, 0).otherwise((F.least(lit(1), -elev_m / 200) * 255).cast("int"))


def stretched_band(fraction: Column, height: int, sea_level: int, exaggeration: float) -> Column:
    """An altitude band's bound under vertical exaggeration; below the sea it stays."""
    above = fraction * height - sea_level
    return F.when(above <= 0, fraction).otherwise(F.least(lit(1), (above * exaggeration + sea_level) / height))


def recommended_height(peak_blocks: Column) -> Column:
    return F.least(F.lit(4096), (F.ceil(peak_blocks / 128) * 128).cast("int"))


def human_bytes(n: Column) -> Column:
    """A number of bytes as text: B, or KB or MB with one decimal."""
    shown = lambda x, unit: F.concat(F.round(x, 1).cast("string"), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, shown(n / 1024.0, "KB")).otherwise(shown(n / float(1 << 20), "MB"))
