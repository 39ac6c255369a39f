"""Settings of the engine: read leniently from JSON, put within their bounds, written back."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Name, default, least, most.
NUMBERS = {
    "TileCacheMegabytes": (256, 32, 4096),
    "TerrainTileCacheMegabytes": (256, 32, 4096),
    "TerrainTileSizeBlocks": (256, 64, 1024),
    "MetersPerBlockVertical": (0.0, 0.0, math.inf),
    "TargetPeakFillFraction": (0.92, 0.2, 1.0),
    "PeakQuantile": (0.995, 0.5, 1.0),
    "CalibrationRadiusBlocks": (4096, 512, 4_000_000),
    "CalibrationProbes": (8, 0, 64),
    "ReliefFactor": (1.6, 1.0, 5.0),
    "MinAutoExaggeration": (1.0, 0.05, 100.0),
    "MaxAutoExaggeration": (20.0, 0.05, 100.0),
    "LinearKneeFraction": (0.85, 0.1, 0.99),
    "OceanDepthFraction": (0.9, 0.05, 1.0),
    "SlopeDetailStrength": (1.0, 0.0, 8.0),
    "MoistureMedian": (0.62, 0.01, 100.0),
    "MoistureSpread": (1.0, 0.1, 4.0),
    "RainfallMedianMm": (540.0, 10.0, 10_000.0),
    "RainfallSpread": (0.8, 0.1, 4.0),
    "RainfallBias": (0.05, -1.0, 1.0),
    "TemperatureOffsetC": (0.0, -40.0, 40.0),
    "ForestDensityMultiplier": (1.0, 0.0, 4.0),
    "ShrubDensityMultiplier": (1.0, 0.0, 4.0),
    "SeasonalTemperatureStrength": (1.0, 0.0, 4.0),
    "SeasonalPrecipitationStrength": (1.0, 0.0, 4.0),
    "StartingClimateSearchRadiusBlocks": (65_536, 512, 4_000_000),
    "StartingClimateNorthSouthCost": (2.0, 1.0, 100.0),
}
# Name, "not set", least, most. Zero stands for "not set"; anything else is put within the bounds.
OVERRIDES = {"ScaleOverride": (0, 1, 16), "VerticalExaggerationOverride": (0.0, 0.05, 20.0)}
# Name and what it may be, the default first.
CHOICES = {
    "HeightMode": ("isotropic", "manual", "auto"),
    "RainfallBasis": ("moisture", "precipitation"),
    "ClimateMode": ("", "full", "off"),
}
# Name, default.
SWITCHES = {
    "SeasonalTemperature": True,
    "SeasonalPrecipitation": True,
    "SeasonHemispheres": False,
    "RescaleBlockLayerAltitudes": True,
    "BareSlopeRock": True,
    "GlacierIce": True,
    "StartingClimateSearch": True,
    "VerboseInference": False,
}


def _number(found, default, low, high):
    """found within [low, high]; the default for what isn't a finite number."""
    if isinstance(found, bool) or not isinstance(found, int | float) or not math.isfinite(found):
        return default
    held = min(max(found, low), high)
    return int(held) if isinstance(default, int) else float(held)


def settings(given: Mapping | None = None) -> dict:
    """All settings: those given, put within their bounds, and defaults for the rest. Unknown names are ignored."""
    given = given or {}
    out: dict = {k: _number(given.get(k), *v) for k, v in NUMBERS.items()}
    out["TerrainTileSizeBlocks"] -= out["TerrainTileSizeBlocks"] % 32
    out["MaxAutoExaggeration"] = max(out["MinAutoExaggeration"], out["MaxAutoExaggeration"])
    for k, (default, low, high) in OVERRIDES.items():
        found = given.get(k)
        out[k] = _number(found, default, low, high) if found and found == found and isinstance(found, int | float) and found > 0 else default
    for k, choices in CHOICES.items():
        found = str(given.get(k) or "").strip().lower()
        out[k] = found if found in choices else choices[0]
    for k, default in SWITCHES.items():
        out[k] = given[k] if isinstance(given.get(k), bool) else default
    return out


def load(spark: SparkSession, path: str) -> dict:
    """The settings of one JSON file in any store that Spark reads; defaults where it is missing or damaged."""
    try:
        rows = spark.read.text(path, wholetext=True).head(1)
        found = json.loads(rows[0][0]) if rows else {}
    except Exception as problem:  # a missing file has an error class of the session's own
        if not isinstance(problem, json.JSONDecodeError) and "PATH_NOT_FOUND" not in str(problem):
            raise
        found = {}
    return settings(found if isinstance(found, dict) else {})


def save(spark: SparkSession, path: str, values: Mapping) -> None:
    """One JSON text under path, put within its bounds first."""
    text = json.dumps(settings(values), indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def typed(value: Column, kind: str, default) -> Column:
    """A world attribute that may be text: its value as kind, the default where it is blank or can't be read."""
    text = F.trim(value.cast("string"))
    return F.coalesce(F.when(text != "", text).try_cast(kind), F.lit(default).cast(kind))
