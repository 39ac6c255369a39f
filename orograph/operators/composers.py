"""Elevation and climate put together from the outputs of sampling stages: weighted sums over the lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.climate import lit, signed_square
from orograph.operators.borders import resize_extrapolated
from orograph.operators.raster import bilinear_resize, gaussian_blur, laplacian_decode, local_lapse


def normalised(total: Column, weight: Column, std: float = 1.0, mean: float = 0.0) -> Column:
    """A weighted sum brought back to its unit; the mean where the weight is next to nothing."""
    return F.when(weight > 1e-6, total / weight).otherwise(0.0) * std + mean


def bilinear_points(points: DataFrame, cells: DataFrame, values: list[str], rows: int, cols: int, y: str = "gy", x: str = "gx") -> DataFrame:
    """points with each value read between the four nearest cells; places beyond the field are drawn to its edge.

    Each different place is read once: one equi-join on its corners and one partial aggregation by
    the place itself, which then brings the values back to all points there. Nothing depends on the
    order of rows. A point without a place, or whose four cells are all missing, has nulls.
    """
    corners = points.select(F.col(y).alias("_y"), F.col(x).alias("_x")).where("_y is not null and _x is not null").distinct()
    for name, at, n in (("i", "_y", rows), ("j", "_x", cols)):
        place = F.greatest(lit(0), F.least(lit(n - 1), F.col(at)))
        base = F.floor(place)
        part = place - base
        ends = F.array(F.struct(base.alias("at"), (1 - part).alias("w")), F.struct(F.least(F.lit(n - 1), base + 1).alias("at"), part.alias("w")))
        corners = corners.withColumn(f"_{name}", F.explode(ends)).withColumn(name, F.col(f"_{name}.at").cast("long"))
    corners = corners.select("_y", "_x", "i", "j", (F.col("_i.w") * F.col("_j.w")).alias("_w")).where("_w > 0")
    read = corners.join(cells.select("i", "j", *values), ["i", "j"]).groupBy("_y", "_x").agg(*[F.sum(F.col(v) * F.col("_w")).alias(v) for v in values])
    return points.withColumn("_y", F.col(y)).withColumn("_x", F.col(x)).join(read, ["_y", "_x"], "left").drop("_y", "_x")


def laplacian_denoise(residual: DataFrame, low: DataFrame, value: str, low_shape: tuple[int, int], shape: tuple[int, int], sigma: float = 5.0) -> DataFrame:
    """(i, j, value): a new low-resolution field: decoded with extrapolated edges, brought down again and blurred."""
    up = resize_extrapolated(low, value, *low_shape, *shape).withColumnRenamed(value, "_up")
    decoded = residual.join(up, ["i", "j"]).select("i", "j", (F.col(value) + F.col("_up")).alias(value))
    return gaussian_blur(bilinear_resize(decoded, value, *shape, *low_shape), value, *low_shape, sigma)


def compose_elevation(residual: DataFrame, latent: DataFrame, low_shape: tuple[int, int], shape: tuple[int, int], residual_scale: tuple[float, float], low_scale: tuple[float, float], sigma: float = 5.0) -> DataFrame:
    """(i, j, elev_m) from residual (i, j, s, w) at full and latent (i, j, s, w) at low resolution; scales are (std, mean).

    Both are weighed back, the low field is denoised and decoded again, and the signed root undone.
    """
    fine = residual.select("i", "j", normalised(F.col("s"), F.col("w"), *residual_scale).alias("v"))
    coarse = latent.select("i", "j", normalised(F.col("s"), F.col("w"), *low_scale).alias("v"))
    better = laplacian_denoise(fine, coarse, "v", low_shape, shape, sigma)
    return laplacian_decode(fine, better, "v", low_shape, shape).select("i", "j", signed_square(F.col("v")).alias("elev_m"))


def compose_climate(elevation: DataFrame, coarse: DataFrame, rows: int, cols: int, per_cell: int, window: int = 15) -> DataFrame:
    """(i, j, temperature_c, ..., beta) of native pixels (i, j, elev_m) from coarse cells (i, j, root, temp, seasonality, precip, precip_cv).

    The lapse of each coarse cell's surroundings brings its temperature to sea level; base, lapse and
    the other variables are read between cells, and the pixel's own height puts the lapse back.
    A pixel nearer to the rim than half a window reads the nearest cell that has a full one; without
    any full window there are no rows.
    """
    pad = window // 2
    root = F.greatest(lit(0), F.col("root"))
    lapse = local_lapse(coarse.select("i", "j", "temp", (root * root).alias("e")), "temp", "e", window)
    full = coarse.select("i", "j", "seasonality", "precip", "precip_cv").join(lapse, ["i", "j"]).withColumn("i", F.col("i") - pad).withColumn("j", F.col("j") - pad)
    at = {c: (F.col(c) + 0.5) / per_cell - 0.5 - pad for c in ("i", "j")}
    pixels = elevation.select("i", "j", "elev_m", at["i"].alias("gy"), at["j"].alias("gx"))
    pixels = pixels.withColumnRenamed("i", "_pi").withColumnRenamed("j", "_pj")
    read = bilinear_points(pixels, full, ["base", "beta", "seasonality", "precip", "precip_cv"], rows - 2 * pad, cols - 2 * pad).where("base is not null")
    temp = F.col("base") + F.col("beta") * F.greatest(lit(0), F.col("elev_m"))
    return read.select(
        F.col("_pi").alias("i"), F.col("_pj").alias("j"), temp.alias("temperature_c"), F.col("seasonality").alias("temperature_seasonality"),
        F.col("precip").alias("precipitation_mm"), F.col("precip_cv").alias("precipitation_cv"), "beta",
    )
