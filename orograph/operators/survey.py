"""The tallest ground of a region from a coarse survey and full-detail probes, and the search for a place to start."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.functions.climate import lit
from orograph.operators.search import best, box_series, in_band

#: Land cells that make a distribution, cells to each side of the centre at most, and cells that a spawn search looks into.
LEAST_LAND, MOST_HALF, REFINED = 16, 128, 4


def survey_box(cells: DataFrame, centre: tuple[int, int], half: int) -> DataFrame:
    """One row (half): half the side of the first box, doubling up to 256 cells, with LEAST_LAND land cells; of the last if none has."""
    series = box_series(half, MOST_HALF)
    inside = [F.col("i").between(centre[0] - h, centre[0] + h - 1) & F.col("j").between(centre[1] - h, centre[1] + h - 1) & (F.col("elev_m") > 0) for h in series]
    counts = cells.agg(*[F.count_if(c).alias(f"n{h}") for h, c in zip(series, inside, strict=True)])
    found = None
    for h in series:
        enough = F.col(f"n{h}") >= LEAST_LAND
        found = F.when(enough, h) if found is None else found.when(enough, h)
    return counts.select(found.otherwise(series[-1]).alias("half"))


def calibration(cells: DataFrame, pixels: DataFrame, centre: tuple[int, int], half: int, quantile: float = 0.995, probes: int = 8, relief: float = 1.6) -> DataFrame:
    """One row (half, land_cells, survey_m, pool_cells, probes, peak_m); none if the box has no land.

    The survey ranks the land cells (i, j, elev_m) of a box of 256 x 256 cells at most. Probes,
    strided over its highest cells, bring in the full-detail pixels (i, j, elev_m) of their cells:
    what only the tail of all land exceeds is the matching upper quantile of those pixels. Without
    any land pixel the survey's own quantile times the relief stands in.
    """
    tail = 1 - quantile
    box = survey_box(cells, centre, half)
    di, dj = F.col("i") - centre[0], F.col("j") - centre[1]
    land = cells.where("elev_m > 0").crossJoin(F.broadcast(box)).where(di.between(-F.col("half"), F.col("half") - 1) & dj.between(-F.col("half"), F.col("half") - 1))
    # at most 65,536 rows by the box, whatever the table's size
    ranks = Window.orderBy(F.desc("elev_m"), "i", "j")
    ranked = land.select("half", "i", "j", "elev_m", (F.row_number().over(ranks) - 1).alias("k"), F.count("*").over(Window.partitionBy("half")).alias("n"))
    n = F.col("n")
    place = F.least(F.floor(n * tail), n - 1)
    pool = F.greatest(F.least(F.lit(3), n), F.least(n, F.ceil(n * (2.0 * tail))))
    ranked = ranked.withColumn("pool", pool.cast("long")).withColumn("probes", F.least(F.lit(probes), F.col("pool")).cast("long"))
    survey = ranked.where(F.col("k") == place).select("half", F.col("n").alias("land_cells"), F.col("elev_m").alias("survey_m"), F.col("pool").alias("pool_cells"), "probes")
    strided = F.transform(F.sequence(F.lit(0).cast("long"), F.col("probes") - 1), lambda p: F.floor(p * F.col("pool") / F.col("probes")).cast("long"))
    probed = ranked.where((F.col("probes") > 0) & (F.col("k") < F.col("pool"))).where(F.array_contains(strided, F.col("k").cast("long"))).select("i", "j", "n", "pool")
    seen = pixels.where("elev_m > 0").join(F.broadcast(probed), ["i", "j"]).select("elev_m", "n", "pool")
    seen = seen.select("elev_m", "n", "pool", (F.row_number().over(Window.orderBy(F.desc("elev_m"))) - 1).alias("k"), F.count("*").over(Window.partitionBy("pool")).alias("m"))
    share = F.least(lit(1), tail / (F.col("pool") / F.col("n")))
    peak = seen.where(F.col("k") == F.least(F.floor(F.col("m") * share), F.col("m") - 1)).agg(F.max("elev_m").alias("probed_m"))
    return survey.crossJoin(F.broadcast(peak)).select("half", "land_cells", "survey_m", "pool_cells", "probes", F.coalesce("probed_m", F.col("survey_m") * relief).alias("peak_m"))


def fitted(measured: DataFrame, headroom: int, metres_per_block: float = 15.0, fill: float = 0.92, least: float = 1.0, most: float = 20.0) -> DataFrame:
    """measured with the vertical gain (exaggeration, blocks_per_metre) that lets peak_m reach its share of the headroom, whether it was clamped, and the height asked for."""
    wanted = F.lit(fill * headroom * metres_per_block) / F.col("peak_m")
    usable = F.col("peak_m") > 1
    allowed = F.when(usable, F.greatest(lit(least), F.least(lit(most), wanted))).otherwise(1.0)
    return measured.select("*", allowed.alias("exaggeration"), (allowed / metres_per_block).alias("blocks_per_metre"), (usable & (allowed < wanted)).alias("clamped"))


def spawn_refined(shortlist: DataFrame, tiles: DataFrame, low: float, high: float, order: list[str]) -> DataFrame:
    """At most one row: the cheapest in-band land column of the first cell that has one.

    shortlist: cells (i, j) in the order of the columns named, of which REFINED are looked into;
    tiles: their full-detail columns (i, j, block_x, block_z, elev_m, temp_c, cost).
    """
    first = best(shortlist, order, REFINED).select("i", "j", F.struct(*order).alias("_order"))
    found = tiles.join(F.broadcast(first), ["i", "j"]).where((F.col("elev_m") > 0) & in_band(F.col("temp_c"), low, high))
    return best(found, ["_order", "cost", "block_z", "block_x"]).select("i", "j", "block_x", "block_z", "temp_c", "cost")
