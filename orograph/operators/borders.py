"""What happens at edges: resampling with an extrapolated border, and tapering towards neighbouring chunks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.operators.raster import bilinear_resize


def _extended(cells: DataFrame, value: str, axis: str, keep: str, n: int) -> DataFrame:
    """The cells with one more row at each end of axis, on the line through the two nearest; a single row is repeated."""
    parts = [cells]
    for at, near, inner in ((-1, 0, 1), (n, n - 1, n - 2)):
        ends = cells.where(F.col(axis).isin(near, inner) if n > 1 else F.col(axis) == near)
        weight = F.when(F.col(axis) == near, 2 if n > 1 else 1).otherwise(-1)
        ends = ends.groupBy(keep).agg(F.sum(F.col(value) * weight).alias(value))
        parts.append(ends.withColumn(axis, F.lit(at).cast("long")))
    return reduce(DataFrame.unionByName, parts)


def resize_extrapolated(cells: DataFrame, value: str, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """(i, j, value): bilinear resampling of a field that goes on linearly for one cell beyond its edges.

    The border is made of the two outermost rows and columns alone, so that the cells themselves
    aren't shuffled for it.
    """

    def away(x: float) -> int:
        return math.floor(x + 0.5)

    source = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(value).cast("double").alias(value))
    padded = _extended(_extended(source, value, "i", "j", rows), value, "j", "i", cols)
    padded = padded.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), value)
    out = bilinear_resize(padded, value, rows + 2, cols + 2, away(to_rows + 2 * to_rows / rows), away(to_cols + 2 * to_cols / cols))
    top, left = away(to_rows / rows), away(to_cols / cols)
    out = out.where(F.col("i").between(top, top + to_rows - 1) & F.col("j").between(left, left + to_cols - 1))
    return out.select((F.col("i") - top).alias("i"), (F.col("j") - left).alias("j"), value)


def border_taper(heights: DataFrame, requested: DataFrame, height: str = "height", size: int = 32) -> DataFrame:
    """(cx, cz, x, z, y, weight) for the columns of requested chunks (cx, cz) that have a finished neighbour.

    heights: the columns (cx, cz, x, z) of finished chunks; only their edges are read on. y is the
    mean height of the facing edge columns, weighted by the square of their nearness, and weight
    the largest of these. A diagonal neighbour counts only where neither of the two chunks between
    has been finished. The mean's numerator has weights of 0.0001 at least, its denominator hasn't.
    """
    last = size - 1
    around = [F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx in (-1, 0, 1) for dz in (-1, 0, 1) if dx or dz]

    def facing(step: str, at: str):
        # the edge that a neighbour in this direction turns to the chunk
        return (F.col(step) == 0) | ((F.col(step) == 1) & (F.col(at) == 0)) | ((F.col(step) == -1) & (F.col(at) == last))

    edge = heights.where(F.col("x").isin(0, last) | F.col("z").isin(0, last)).withColumn("d", F.explode(F.array(*around)))
    edge = edge.select("cx", "cz", F.col("x").alias("hx"), F.col("z").alias("hz"), F.col(height).alias("h"), "d.dx", "d.dz")
    edge = edge.where(facing("dx", "hx") & facing("dz", "hz"))
    edge = edge.withColumn("cx", F.col("cx") - F.col("dx")).withColumn("cz", F.col("cz") - F.col("dz"))
    near = edge.join(requested.select("cx", "cz").distinct(), ["cx", "cz"])
    chunk = Window.partitionBy("cx", "cz")
    sides = F.collect_set(F.when((F.col("dx") == 0) | (F.col("dz") == 0), F.struct("dx", "dz"))).over(chunk)
    near = near.withColumn("sides", sides)
    zero = F.lit(0)
    between = F.array_contains("sides", F.struct(F.col("dx"), zero.alias("dz"))) | F.array_contains("sides", F.struct(zero.alias("dx"), F.col("dz")))
    near = near.where((F.col("dx") == 0) | (F.col("dz") == 0) | ~between).drop("sides")

    def along(step: str, at: str):
        return F.explode(F.when(F.col(step) == 0, F.array(F.col(at).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(last))))

    def gap(step: str, at: str):
        return F.when(F.col(step) == 0, 0.0).when(F.col(step) == 1, 1 - (F.col(at) + 1) / float(size)).otherwise(F.col(at) / float(size))

    taps = near.withColumn("x", along("dx", "hx")).withColumn("z", along("dz", "hz"))
    taps = taps.withColumn("w", F.pow(F.greatest(F.lit(0.0), 1 - gap("dx", "x") - gap("dz", "z")), 2.0))
    least = F.lit(0.0001)
    mean = F.sum((F.col("h") + 0.5) * F.greatest(least, "w")) / F.greatest(least, F.sum("w"))
    return taps.groupBy("cx", "cz", "x", "z").agg(mean.alias("y"), F.max("w").alias("weight"))
