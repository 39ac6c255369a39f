"""Tiles: blocks joined to the cells of tiles, tiles put together from elevation and climate, maps over regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.climate import lit
from orograph.functions.mapping import HeightMap
from orograph.operators.grid import tile_of

CLIMATE = ("temperature_c", "temperature_seasonality", "precipitation_mm", "precipitation_cv")


def inside_world(block_x: Column, block_z: Column, size_x: int, size_z: int) -> Column:
    """Whether a block lies on the map."""
    return block_x.between(0, size_x - 1) & block_z.between(0, size_z - 1)


def to_native(block: Column, origin: int, scale: int) -> Column:
    """The native pixel that holds a block."""
    return F.floor((block - origin) / float(max(1, scale))).cast("long")


def to_block(native: Column, origin: int, scale: int, per_cell: int = 1) -> Column:
    """The block at the middle of a cell of so many native pixels."""
    return (native * per_cell + per_cell // 2) * max(1, scale) + origin


def with_tile(positions: DataFrame, tile_cells: DataFrame, size: int, x: str = "block_x", z: str = "block_z") -> DataFrame:
    """Each position with the columns of its cell (tile_x, tile_z, x, z) of a tile; a position without one has nulls.

    One equi-join on the four keys, so that a tile's cells are read once however many positions ask.
    """
    tile_x, in_x = tile_of(F.col(x), size)
    tile_z, in_z = tile_of(F.col(z), size)
    keyed = positions.withColumn("tile_x", tile_x).withColumn("tile_z", tile_z).withColumn("_x", in_x).withColumn("_z", in_z)
    held = tile_cells.withColumnRenamed("x", "_x").withColumnRenamed("z", "_z")
    return keyed.join(held, ["tile_x", "tile_z", "_x", "_z"], "left").drop("_x", "_z")


def assemble(elevation: DataFrame, slope: DataFrame, heights: HeightMap, climate: DataFrame | None = None) -> DataFrame:
    """(i, j, elevation_m, surface_y, slope) and, with climate, its four variables, rain never below 0; nulls where climate lacks the cell."""
    out = elevation.select("i", "j", F.col("elev_m").alias("elevation_m")).join(slope.select("i", "j", "slope"), ["i", "j"])
    out = out.withColumn("surface_y", heights.block_y(F.col("elevation_m")))
    if climate is None:
        return out.select("i", "j", "elevation_m", "surface_y", "slope")
    rain = {c: F.when(F.col(c).isNotNull(), F.greatest(lit(0), F.col(c))) for c in ("precipitation_mm", "precipitation_cv")}
    out = out.join(climate.select("i", "j", *CLIMATE), ["i", "j"], "left")
    return out.select("i", "j", "elevation_m", "surface_y", "slope", *[rain.get(c, F.col(c)).alias(c) for c in CLIMATE])


def slope_detail(cells: DataFrame, value: str, slope: str, coarse: str, fine: str, pixel_m: float, native_m: float, strength: float = 1.0) -> DataFrame:
    """cells with detail from two noise columns added to value where land slopes; nothing at sea."""
    if strength <= 0:
        return cells
    share = pixel_m / native_m
    steep = F.least(lit(1), F.col(slope) * pixel_m / (40 * share))
    steep = steep * steep * F.sqrt(steep)
    added = F.col(value) + F.col(coarse) * (100 * share * strength) * steep + F.col(fine) * (70 * share * strength) * steep
    return cells.withColumn(value, F.when(F.col(value) < 0, F.col(value)).otherwise(added))


def tapered(surface: Column, target: Column, weight: Column, height: int) -> Column:
    """A surface drawn towards a taper's target by its weight (nulls: not at all), within the world."""
    drawn = F.when(weight > 0, (surface + (target - surface) * weight).cast("int")).otherwise(surface)
    return F.greatest(F.lit(1), F.least(F.lit(height - 2), drawn))


def with_geology(climate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Packed climate of each place (x, z, value) with the lowest byte of the baseline's; a place that it lacks keeps its own."""
    low = baseline.select("x", "z", F.col("value").bitwiseAND(255).alias("_low"))
    out = climate.join(low, ["x", "z"], "left")
    return out.withColumn("value", F.col("value").bitwiseOR(F.coalesce("_low", F.lit(0)))).drop("_low")


def region_map(cells: DataFrame, region_size: int, step: int, value: Column, x: str = "block_x", z: str = "block_z") -> DataFrame:
    """(region_x, region_z, x, z, value): cells at every step-th block as the maps of regions, with one more row and column.

    The additional ones are the first of the next region, so a border cell stands in up to four maps.
    """
    inner = max(1, region_size // step)

    def places(at: Column) -> Column:
        own, local = F.floor(at / float(region_size)).cast("long"), F.floor(F.pmod(at, F.lit(region_size)) / float(step)).cast("long")
        here = F.struct(own.alias("region"), local.alias("at"))
        return F.when(local == 0, F.array(here, F.struct((own - 1).alias("region"), F.lit(inner).cast("long").alias("at")))).otherwise(F.array(here))

    kept = cells.where((F.pmod(F.col(x), F.lit(step)) == 0) & (F.pmod(F.col(z), F.lit(step)) == 0))
    out = kept.select(F.explode(places(F.col(x))).alias("a"), z, value.alias("value")).select("a", "value", F.explode(places(F.col(z))).alias("b"))
    return out.select(F.col("a.region").alias("region_x"), F.col("b.region").alias("region_z"), F.col("a.at").alias("x"), F.col("b.at").alias("z"), "value")


def write_region_maps(maps: DataFrame, path: str) -> None:
    """Region maps as Parquet, a folder for each region, sorted by place."""
    maps.repartition("region_x", "region_z").sortWithinPartitions("region_x", "region_z", "z", "x").write.mode("overwrite").partitionBy("region_x", "region_z").parquet(path)


def map_at(positions: DataFrame, maps: DataFrame, region_size: int, inner: int, x: str = "block_x", z: str = "block_z") -> DataFrame:
    """Each position with the bytes (high, middle, low) of its region's map, blended over the four nearest places; null without a map.

    Each byte is blended by itself and cut to a whole number. Each different position is read once
    and keyed by itself, so that nothing depends on the order of rows.
    """
    spot = positions.select(F.col(x).alias("_x"), F.col(z).alias("_z")).where("_x is not null and _z is not null").distinct()
    for name in "xz":
        at = F.pmod(F.col(f"_{name}"), F.lit(region_size)) * (inner / region_size)
        spot = spot.withColumn(f"region_{name}", F.floor(F.col(f"_{name}") / float(region_size)).cast("long")).withColumn(f"_a{name}", at)
    taps = spot.withColumn("dx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dz", F.explode(F.array(F.lit(0), F.lit(1))))
    part = {c: F.col(f"_a{c}") - F.floor(f"_a{c}") for c in "xz"}
    weight = F.when(F.col("dx") == 0, 1 - part["x"]).otherwise(part["x"]) * F.when(F.col("dz") == 0, 1 - part["z"]).otherwise(part["z"])
    taps = taps.select("_x", "_z", "region_x", "region_z", (F.floor("_ax") + F.col("dx")).cast("long").alias("x"), (F.floor("_az") + F.col("dz")).cast("long").alias("z"), weight.alias("w")).where("w > 0")
    found = taps.join(maps, ["region_x", "region_z", "x", "z"])
    bytes_ = [F.floor(F.sum(F.shiftright("value", s).bitwiseAND(255) * F.col("w")) + 1e-9).cast("int").alias(n) for n, s in (("high", 16), ("middle", 8), ("low", 0))]
    blended = found.groupBy("_x", "_z").agg(*bytes_)
    return positions.withColumn("_x", F.col(x)).withColumn("_z", F.col(z)).join(blended, ["_x", "_z"], "left").drop("_x", "_z")
