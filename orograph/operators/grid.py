"""Windows over a lattice: assignment, overlap-add, demand, halos.

A window w covers [w * stride + offset, + size). Overlap joins are equi-joins on window numbers
worked out from a cell's place, so that nothing is compared by range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Windows:
    size: int
    stride: int
    offset: int = 0

    def lowest(self, start: Column) -> Column:
        """Number of the first window that holds a place from start on."""
        return F.ceil((start - (self.offset + self.size - 1)) / float(self.stride)).cast("long")

    def highest(self, end: Column) -> Column:
        """Number of the last window that holds a place before end."""
        return F.floor((end - 1 - self.offset) / float(self.stride)).cast("long")

    def start(self, w: Column) -> Column:
        return w * self.stride + self.offset

    def covering(self, at: Column) -> Column:
        """Numbers of all windows that hold a place; none where windows leave gaps."""
        low, high = self.lowest(at), self.highest(at + 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def tent(local: Column, size: int) -> Column:
    """Blend weight of a place in its window: 1 in the middle, 0.001 at the ends."""
    mid = (size - 1) / 2
    return 1 - F.least(F.lit(1.0), F.abs(local - mid) / mid) * (1 - 1e-3)


def to_windows(cells: DataFrame, w: Windows, i: str = "i", j: str = "j") -> DataFrame:
    """Each cell once for every window that holds it: wi, wj and its place li, lj there."""
    out = cells.withColumn("wi", F.explode(w.covering(F.col(i)))).withColumn("wj", F.explode(w.covering(F.col(j))))
    return out.withColumn("li", F.col(i) - w.start(F.col("wi"))).withColumn("lj", F.col(j) - w.start(F.col("wj")))


def overlap_add(windowed: DataFrame, value: str, weight: Column | str, i: str = "i", j: str = "j", eps: float = 1e-6) -> DataFrame:
    """(i, j, value, weight): the weighted mean over the windows of each cell, 0 where the weight is next to nothing."""
    w = F.col(weight) if isinstance(weight, str) else weight
    sums = windowed.groupBy(i, j).agg(F.sum(F.col(value) * w).alias("s"), F.sum(w).alias("weight"))
    return sums.select(i, j, F.when(F.col("weight") > eps, F.col("s") / F.col("weight")).otherwise(0.0).alias(value), "weight")


def needed(requested: DataFrame, w: Windows) -> DataFrame:
    """Distinct windows (wi, wj) that the requested ranges (i0, i1, j0, j1) meet; ranges stay apart, no box is put around them."""
    rows = F.sequence(w.lowest(F.col("i0")), w.highest(F.col("i1")))
    cols = F.sequence(w.lowest(F.col("j0")), w.highest(F.col("j1")))
    return requested.select(F.explode(rows).alias("wi"), cols.alias("c")).select("wi", F.explode("c").alias("wj")).distinct()


def pending(requested: DataFrame, w: Windows, cached: DataFrame) -> DataFrame:
    """Distinct windows (wi, wj) that the requested ranges (i0, i1, j0, j1) need and the cache lacks."""
    return needed(requested, w).join(cached.select("wi", "wj"), ["wi", "wj"], "left_anti")


def sliced(cells: DataFrame, i0: int, i1: int, j0: int, j1: int, i: str = "i", j: str = "j") -> DataFrame:
    """The cells of a half-open range, numbered from its start."""
    kept = cells.where(F.col(i).between(i0, i1 - 1) & F.col(j).between(j0, j1 - 1))
    return kept.withColumns({i: F.col(i) - i0, j: F.col(j) - j0})


def clamped_crop(cells: DataFrame, i0: int, j0: int, height: int, width: int, rows: int, cols: int, i: str = "i", j: str = "j") -> DataFrame:
    """A range of height x width places from (i0, j0), numbered from its start; beyond the lattice of rows x cols the nearest edge is repeated.

    Each cell goes to the places that it stands for, a run of them on each axis, so that nothing is joined.
    """

    def places(at: str, start: int, size: int, n: int) -> Column:
        own = F.col(at) - start
        low = F.when(F.col(at) == 0, F.lit(0)).otherwise(own)
        high = F.when(F.col(at) == n - 1, F.lit(size - 1)).otherwise(own)
        low, high = F.greatest(F.lit(0), low), F.least(F.lit(size - 1), high)
        return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    kept = cells.where(F.col(i).between(0, rows - 1) & F.col(j).between(0, cols - 1))
    return kept.withColumn(i, F.explode(places(i, i0, height, rows))).withColumn(j, F.explode(places(j, j0, width, cols)))


def intersect(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> tuple[Column, Column]:
    return F.greatest(lo_a, lo_b), F.least(hi_a, hi_b)


def tile_of(x: Column, size: int) -> tuple[Column, Column]:
    """(tile, place in the tile) of a block, floor division."""
    return F.floor(x / float(size)).cast("long"), F.pmod(x, F.lit(size)).cast("long")


def spread(cells: DataFrame, reach: int, i: str = "i", j: str = "j") -> DataFrame:
    """Each cell as a neighbour, at di and dj, of every place (ti, tj) within reach.

    Turns 2-D frames into equi-keyed groups, which aggregate partially before they are shuffled.
    """
    d = F.sequence(F.lit(-reach), F.lit(reach))
    out = cells.withColumn("di", F.explode(d)).withColumn("dj", F.explode(d))
    return out.withColumn("ti", F.col(i) - F.col("di")).withColumn("tj", F.col(j) - F.col("dj"))
