"""Columns of ground filled with voxels, and what the surface pass makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOFT = ("soil", "gravel", "sand")


def fill_columns(columns: DataFrame, sea_level: int, surface: str = "surface_y", ocean: Column | None = None, freezes: Column | None = None) -> DataFrame:
    """One row for each voxel (y, block, fluid) from the mantle to the surface or the sea: rock, water, lake ice."""
    out = columns.withColumn("y", F.explode(F.sequence(F.lit(0), _top(F.col(surface), sea_level))))
    block, fluid = _held(F.col("y"), F.col(surface), sea_level, ocean, freezes)
    return out.withColumn("block", block).withColumn("fluid", fluid)


def _top(surface: Column, sea_level: int) -> Column:
    return F.greatest(surface, F.lit(sea_level - 1))


def _held(y: Column, surface: Column, sea_level: int, ocean: Column | None, freezes: Column | None) -> tuple[Column, Column]:
    """The block and the fluid of a column at a height from 0 to its top."""
    ocean, freezes = (F.lit(False) if x is None else x for x in (ocean, freezes))
    block = F.when(y == 0, "mantle").when(y <= surface, "rock")
    ice = (y == sea_level - 1) & freezes & ~ocean
    fluid = F.when((y > surface) & (y > 0), F.when(ice, "lakeice").when(ocean, "saltwater").otherwise("water"))
    return block, fluid


def voxels_at(asked: DataFrame, columns: DataFrame, sea_level: int, surface: str = "surface_y", ocean: Column | None = None, freezes: Column | None = None) -> DataFrame:
    """asked (i, j, y and more) with the block and fluid that fill_columns() has there: nulls where it has none.

    Columns meet what is asked of them by their places, and a voxel is worked out where they meet, so
    that neither side holds a row for a voxel that nobody asked for, and neither is sent to all tasks.
    """
    # _found tells a voxel of nulls from none: a column whose surface is null has both
    ground = columns.select("i", "j", F.col(surface).alias("_surface"), (F.lit(False) if ocean is None else ocean).alias("_ocean"), (F.lit(False) if freezes is None else freezes).alias("_freezes"), F.lit(True).alias("_found"))
    a, c = asked.alias("a"), ground.hint("merge").alias("c")
    y = F.col("a.y")
    inside = (y >= 0) & (y <= _top(F.col("c._surface"), sea_level))
    met = a.join(c, (F.col("a.i") == F.col("c.i")) & (F.col("a.j") == F.col("c.j")) & inside, "left")
    block, fluid = _held(y, F.col("c._surface"), sea_level, F.col("c._ocean"), F.col("c._freezes"))
    return met.select("a.*", F.when(F.col("c._found"), block).alias("block"), F.when(F.col("c._found"), fluid).alias("fluid"))


def rain_height(surface: Column, sea_level: int, height: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(height - 2), F.greatest(surface, F.lit(sea_level - 1))))


def buildable(surface: Column, height: int) -> Column:
    """Whether a surface leaves a block below it and one above within the world."""
    return (surface > 0) & (surface < height - 1)


def glacier_cap(voxels: DataFrame, ice: Column, surface: str = "surface_y", depth: int = 3) -> DataFrame:
    """Ice for the topmost blocks of columns under permanent ice; their fluids go."""
    capped = ice & (F.col("y") > F.col(surface) - depth) & (F.col("y") <= F.col(surface)) & F.col("block").isNotNull()
    return voxels.withColumn("fluid", F.when(capped, None).otherwise(F.col("fluid"))).withColumn("block", F.when(capped, "glacierice").otherwise(F.col("block")))


def scour(voxels: DataFrame, steep: Column, column: list[str], surface: str = "surface_y", most: int = 12) -> DataFrame:
    """Rock for the soft blocks on top of steep columns, down to the first that isn't soft, at most so many."""
    down = Window.partitionBy(*column).orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
    solid = (F.col("y") <= F.col(surface)) & ~F.coalesce(F.col("block"), F.lit("air")).isin(*SOFT)
    blocked = F.max(F.when(solid, 1).otherwise(0)).over(down)
    hit = steep & (F.col("y") <= F.col(surface)) & (F.col("y") > F.col(surface) - most) & (F.col("_blocked") == 0)
    return voxels.withColumn("_blocked", blocked).withColumn("block", F.when(hit, "rock").otherwise(F.col("block"))).drop("_blocked")


def surfaced(voxels: DataFrame, ice: Column, steep: Column, column: list[str]) -> DataFrame:
    """Both surface passes in their order: ice first, so that steep ground under it keeps its soft blocks."""
    return scour(glacier_cap(voxels, ice), steep, column)


# ---- columns as runs: no row for a block, no window for a column -------------------------------

#: The runs of a column, from below: equal blocks and fluids from low to high.
RUNS = "array<struct<block:string,fluid:string,low:int,high:int>>"


def _run(block, fluid, low, high) -> Column:
    as_text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(as_text(block).alias("block"), as_text(fluid).alias("fluid"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def filled_runs(surface: Column, sea_level: int, ocean: Column | None = None, freezes: Column | None = None) -> Column:
    """The column of fill_columns() as runs: mantle, rock, water, lake ice."""
    ocean, freezes = (F.lit(False) if x is None else x for x in (ocean, freezes))
    zero, sea = F.lit(0), F.lit(sea_level - 1)
    ice = F.coalesce(freezes & ~ocean, F.lit(False)) & (surface < sea)
    water = F.when(ocean, "saltwater").otherwise("water")
    parts = F.array(
        _run("mantle", None, zero, zero), _run("rock", None, F.lit(1), surface),
        _run(None, water, F.greatest(surface + 1, F.lit(1)), F.when(ice, sea - 1).otherwise(sea)), _run(None, "lakeice", F.when(ice, sea).otherwise(sea + 1), sea),
    )
    return F.filter(parts, lambda r: r["low"] <= r["high"])


def split_at(runs: Column, y: Column) -> Column:
    """The runs, none of which goes from below y to y or above it."""
    two = lambda r: F.array(_run(r["block"], r["fluid"], r["low"], y - 1), _run(r["block"], r["fluid"], y, r["high"]))
    return F.flatten(F.transform(runs, lambda r: F.when((r["low"] < y) & (r["high"] >= y), two(r)).otherwise(F.array(r))))


def glacier_runs(runs: Column, ice: Column, surface: Column, depth: int = 3) -> Column:
    """See glacier_cap()."""
    cut = split_at(split_at(runs, surface - depth + 1), surface + 1)
    capped = lambda r: (r["low"] > surface - depth) & (r["high"] <= surface) & r["block"].isNotNull()
    return F.when(ice, F.transform(cut, lambda r: F.when(capped(r), _run("glacierice", None, r["low"], r["high"])).otherwise(r))).otherwise(runs)


def _once(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often then reads it: lambdas work out anew what isn't their own."""
    return F.element_at(F.transform(F.array(value), then), 1)


def scoured_runs(runs: Column, steep: Column, surface: Column, most: int = 12) -> Column:
    """See scour(): the highest run up to the surface that isn't soft bounds what becomes rock.

    Where that run ends another begins, or it passes the surface, so that runs are cut at the surface and at the
    lowest height that may become rock only.
    """
    least = F.greatest(surface - most, F.lit(-1))
    cut = split_at(split_at(runs, least + 1), surface + 1)
    solid = lambda r: (r["high"] <= surface) & ~F.coalesce(r["block"], F.lit("air")).isin(*SOFT)
    stop = lambda rs: F.aggregate(rs, least, lambda s, r: F.when(solid(r), F.greatest(s, r["high"])).otherwise(s))
    hit = lambda r, s: (r["low"] > s) & (r["high"] <= surface)
    rock = lambda rs, s: F.transform(rs, lambda r: F.when(hit(r, s), _run("rock", r["fluid"], r["low"], r["high"])).otherwise(r))
    return F.when(steep, _once(cut, lambda rs: _once(stop(rs), lambda s: rock(rs, s)))).otherwise(runs)


def merged_runs(runs: Column) -> Column:
    """The runs with those that touch and are equal made one: a fold along the column."""
    def add(held: Column, r: Column) -> Column:
        last = F.element_at(held, -1)
        same = last["block"].eqNullSafe(r["block"]) & last["fluid"].eqNullSafe(r["fluid"]) & (last["high"] + 1 == r["low"])
        longer = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(_run(last["block"], last["fluid"], last["low"], r["high"])))
        return F.when(F.size(held) == 0, F.array(r)).when(same, longer).otherwise(F.concat(held, F.array(r)))

    return F.aggregate(runs, F.array().cast(RUNS), add)


def expanded(columns: DataFrame, runs: str = "runs") -> DataFrame:
    """columns with a row for each voxel (y, block, fluid) in place of the runs."""
    keep = [c for c in columns.columns if c != runs]
    # outer, as Spark filters what another explode() takes, before anything else, and for that works the runs out twice more
    rows = columns.select(*keep, F.explode_outer(runs).alias("_r")).where("_r is not null")
    return rows.select(*keep, F.explode(F.sequence("_r.low", "_r.high")).alias("y"), F.col("_r.block").alias("block"), F.col("_r.fluid").alias("fluid"))
