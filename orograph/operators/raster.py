"""Stencils, blurs, resampling and windowed regression over cells (i, j)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised weights; the size is twice half of the truncated double sigma, and one."""
    size = int(2 * sigma) // 2 * 2 + 1
    mid = size // 2
    w = [math.exp(-((k - mid) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [x / sum(w) for x in w]


def _taps(df: DataFrame, axis: str, value: str, kernel: list[float], n: int, keep: str) -> DataFrame:
    """One pass of a separable convolution along axis, edges replicated."""
    p = len(kernel) // 2
    at, k = F.col(axis), F.col("k")
    # target t takes from clamp(t + k), so that an edge cell gives to all targets that reach beyond it
    lo = F.when(at == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), at - k))
    hi = F.when(at == n - 1, F.lit(n - 1)).otherwise(F.least(F.lit(n - 1), at - k))
    lo = F.when(at == n - 1, F.greatest(F.lit(0), at - k)).otherwise(lo) if n > 1 else lo
    hi = F.when(at == 0, F.least(F.lit(n - 1), at - k)).otherwise(hi) if n > 1 else hi
    taps = df.select(keep, axis, value, F.posexplode(F.array(*map(F.lit, kernel))).alias("pos", "w")).withColumn("k", F.col("pos") - p)
    taps = taps.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    taps = taps.withColumn("t", F.explode(F.sequence("lo", "hi")))
    return taps.groupBy(F.col("t").alias(axis), keep).agg(F.sum(F.col(value) * F.col("w")).alias(value))


def gaussian_blur(cells: DataFrame, value: str, rows: int, cols: int, sigma: float = 5.0) -> DataFrame:
    """Separable blur, rows then columns."""
    kernel = gaussian_kernel(sigma)
    out = _taps(cells.select("i", "j", F.col(value).cast("double").alias(value)), "j", value, kernel, cols, "i")
    return _taps(out, "i", value, kernel, rows, "j").select("i", "j", value)


def _along(cells: DataFrame, axis: str, keep: str, reach: int, sums: dict[str, Column]) -> DataFrame:
    """One pass of a separable stencil: (axis, keep, sums) of each place over its neighbours along axis; d is a neighbour's distance."""
    near = cells.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_t", F.col(axis) - F.col("d"))
    return near.groupBy(F.col("_t").alias(axis), keep).agg(*[c.alias(k) for k, c in sums.items()])


def sobel_slope(cells: DataFrame, value: str, pixel_m: float) -> DataFrame:
    """(i, j, slope) of the cells whose eight neighbours exist: rise over run by the Sobel stencil, rows first, then columns."""
    v, d = F.col(value), F.col("d")
    smooth = F.when(d == 0, 2).otherwise(1)
    rows = _along(cells.select("i", "j", value), "j", "i", 1, {"dx": F.sum(v * d), "smooth": F.sum(v * smooth), "n": F.count("*")})
    both = _along(rows, "i", "j", 1, {"dx": F.sum(F.col("dx") * smooth), "dy": F.sum(F.col("smooth") * d), "n": F.sum("n")}).where("n = 9")
    return both.select("i", "j", (F.sqrt(F.pow(F.col("dx") / 8, 2.0) + F.pow(F.col("dy") / 8, 2.0)) / pixel_m).alias("slope"))


def land_erosion(cells: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """(i, j) of cells that, with all eight neighbours, are land: value above 0 and weight not next to nothing."""
    land = (F.col(value) > 0) & (weight > 1e-6 if weight is not None else F.lit(True))
    rows = _along(cells.select("i", "j", land.alias("land")), "j", "i", 1, {"n": F.count_if("land")})
    return _along(rows, "i", "j", 1, {"n": F.sum("n")}).where("n = 9").select("i", "j")


def centre_mean(cells: DataFrame, value: str, size: int) -> DataFrame:
    """(i, j, value) of blocks of size x size cells: the mean of the four in the middle."""
    mid = [size // 2 - 1, size // 2]
    kept = cells.where((F.pmod("i", F.lit(size))).isin(mid) & (F.pmod("j", F.lit(size))).isin(mid))
    block = [F.floor(F.col(c) / float(size)).cast("long").alias(c) for c in ("i", "j")]
    return kept.groupBy(*block).agg(F.avg(value).alias(value))


def bilinear_resize(cells: DataFrame, value: str, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """Resampling with half-pixel centres and clamped neighbours, as one equi-join on the four corners."""
    spark = cells.sparkSession

    def axis(n: int, to: int, name: str) -> DataFrame:
        src = (F.col("id") + 0.5) * n / to - 0.5
        base = F.floor(src)
        ends = F.array(F.struct(base.alias("at"), (1 - (src - base)).alias("w")), F.struct((base + 1).alias("at"), (src - base).alias("w")))
        taps = spark.range(to).select(F.col("id").alias(f"t{name}"), F.explode(ends).alias("e"))
        return taps.select(f"t{name}", F.greatest(F.lit(0), F.least(F.lit(n - 1), "e.at")).cast("long").alias(name), F.col("e.w").alias(f"w{name}"))

    source = cells.select(F.col("i").cast("long"), F.col("j").cast("long"), value)
    out = source.join(axis(rows, to_rows, "i"), "i").join(axis(cols, to_cols, "j"), "j")
    return out.groupBy(F.col("ti").alias("i"), F.col("tj").alias("j")).agg(F.sum(F.col(value) * F.col("wi") * F.col("wj")).alias(value))


def nearest_upsample(cells: DataFrame, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """Every target cell with the columns of the source cell at floor(t * n / to)."""
    spark = cells.sparkSession
    axis = lambda n, to, a: spark.range(to).select(F.col("id").alias(f"t{a}"), F.floor(F.col("id") * n / float(to)).cast("long").alias(a))
    out = cells.join(axis(rows, to_rows, "i"), "i").join(axis(cols, to_cols, "j"), "j").drop("i", "j")
    return out.withColumnRenamed("ti", "i").withColumnRenamed("tj", "j")


def local_lapse(cells: DataFrame, temp: str, elev: str, win: int = 15, least_land: float = 0.02) -> DataFrame:
    """(i, j, base, beta): regression of temperature on elevation over the land of each full window.

    beta is clamped to [-0.012, 0], and -0.0065 where the land is too little or too flat; base is
    the centre's temperature brought to sea level.
    """
    pad, n = (win - 1) // 2, win * win
    own = cells.select("i", "j", F.col(temp).cast("double").alias("tc"), F.col(elev).cast("double").alias("ec"))
    land = F.when(F.col("ec") > 0, 1.0).otherwise(0.0)
    t, e = F.col("tc") * land, F.col("ec") * land
    terms = own.select("i", "j", F.lit(1).alias("cells"), land.alias("w"), t.alias("st"), e.alias("se"), (e * F.col("ec")).alias("see"), (e * F.col("tc")).alias("set"))
    add = {k: F.sum(k) for k in terms.columns[2:]}
    sums = _along(_along(terms, "j", "i", pad, add), "i", "j", pad, add).where(F.col("cells") == n).join(own, ["i", "j"])
    den = F.col("w") + 1e-6
    mean = {k: F.col(k) / den for k in ("st", "se", "see", "set")}
    var, cov = mean["see"] - mean["se"] * mean["se"], mean["set"] - mean["se"] * mean["st"]
    beta = F.when((var < 1) | (F.col("w") < least_land * n), -0.0065).otherwise(cov / (var + 1e-6))
    beta = F.greatest(F.lit(-0.012), F.least(F.lit(0.0), beta))
    sums = sums.withColumn("beta", beta)
    return sums.select("i", "j", (F.col("tc") - F.col("beta") * F.col("ec")).alias("base"), "beta")


def laplacian_decode(residual: DataFrame, low: DataFrame, value: str, low_shape: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """Residual plus the upsampled low-resolution field."""
    up = bilinear_resize(low, value, *low_shape, *shape).withColumnRenamed(value, "up")
    return residual.join(up, ["i", "j"]).select("i", "j", (F.col(value) + F.col("up")).alias(value))
