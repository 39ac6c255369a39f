"""Every query over the driver's tables, with the SQL that computes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import climate, mapping, seasons
from orograph.operators import borders, diffusion, fields, grid, noise, raster, search, voxel
from orograph.plans import fitted, worlds  # noqa: F401  register their queries
from orograph.plans.noise_sql import cellular_sql, noise_sql, warped_sql, weighted_sql
from orograph.plans.shared import BIO, CELLS, COVER_SQL, FOREST_SQL, KEYS, ORACLE_SQL, QUERIES, ROWS, SHRUB_SQL, SITES, grid_rows, query  # noqa: F401
from orograph.sources import settings
from orograph.sources.tables import cells, sites, table

def with_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.with_bioclim(sites(spark, sf_dir), "bio1", "bio4", "bio12", "bio15")


# ---- climate -------------------------------------------------------------------------------


@query(f"WITH {BIO} SELECT {COVER_SQL} AS cover, (warmest < 0 AND bio12 > 150) AS ice, count(*) AS n, CAST(sum(CASE WHEN slope >= bare THEN 1 ELSE 0 END) AS BIGINT) AS bare_n, round(avg(tm), 6) AS mean_moisture FROM bio GROUP BY 1, 2")
def cover_classes(spark, sf_dir):
    rows = with_bio(spark, sf_dir)
    return rows.groupBy(climate.cover_class(F.col("b.effective_moisture")).alias("cover"), F.col("b.ice").alias("ice")).agg(
        F.count("*").alias("n"), F.count_if(F.col("slope") >= F.col("b.bare_slope")).alias("bare_n"), F.round(F.avg("b.tree_moisture"), 6).alias("mean_moisture"))


@query(f"WITH {BIO} SELECT l_orderkey, l_linenumber, round(sigma, 6) AS sigma_c, round(pet, 6) AS pet_mm, round(ai, 6) AS aridity, round(tm, 6) AS tree_moisture, round(gsd, 6) AS growing_days, round(coldest, 6) AS coldest_c, round(warmest, 6) AS warmest_c, round(etm, 6) AS effective_moisture, round(bare, 6) AS bare_slope, round({FOREST_SQL}, 6) AS forest, round({SHRUB_SQL}, 6) AS shrub, (warmest < 0 AND bio12 > 150) AS ice FROM bio")
def bioclim_struct(spark, sf_dir):
    rows = with_bio(spark, sf_dir).select(*KEYS, "b.*")
    return rows.select(*KEYS, *[F.round(c, 6).alias(c) for c in rows.columns[2:-1]], "ice")


def rainfall_sql(value: str, median: float, spread: float) -> str:
    return f"""WITH {BIO}, z AS (SELECT l_orderkey, l_linenumber, -((ln(greatest(1e-4, {value})) - ln({median})) / {spread}) / sqrt(2.0) AS x FROM bio),
    t AS (SELECT *, 1 / (1 + 0.5 * abs(x)) AS t FROM z),
    r AS (SELECT *, t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))) AS r FROM t)
    SELECT l_orderkey, l_linenumber, CAST(round_even(greatest(0.0, least(255.0, (0.5 * (CASE WHEN x >= 0 THEN r ELSE 2 - r END) + 0.05) * 255)), 0) AS INT) AS rainfall FROM r"""


@query(rainfall_sql("tm", 0.62, 1.0))
def rainfall_bytes_moisture(spark, sf_dir):
    return with_bio(spark, sf_dir).select(*KEYS, climate.rainfall_byte(F.col("b.tree_moisture")).alias("rainfall"))


@query(rainfall_sql("bio12", 540, 0.8))
def rainfall_bytes_precip(spark, sf_dir):
    return sites(spark, sf_dir).select(*KEYS, climate.rainfall_byte(F.col("bio12"), 540, 0.8).alias("rainfall"))


@query(f"""WITH {SITES} SELECT l_orderkey, l_linenumber,
    round(greatest(-10.0, least(40.0, bio1 + greatest(-9.8, least(-4.0, -6.5 + 0.0015 * bio12)) / 1000 * greatest(0.0, elev_m))), 6) AS temp_c,
    round(bio15 * greatest(0.0, (185 - 0.04111 * bio12) / 185), 6) AS precip_std, round(sign(elev_m / 100) * elev_m / 100 * elev_m / 100, 6) AS squared FROM sites""")
def synthetic_physics(spark, sf_dir):
    e = F.col("elev_m") / 100
    return sites(spark, sf_dir).select(*KEYS, F.round(climate.lapse_corrected(F.col("bio1"), F.col("bio12"), F.col("elev_m")), 6).alias("temp_c"),
        F.round(climate.damped_precip_std(F.col("bio15"), F.col("bio12")), 6).alias("precip_std"), F.round(climate.signed_square(e), 6).alias("squared"))


@query(f"WITH {SITES} SELECT l_orderkey, l_linenumber, round(CASE WHEN bio12 <= 100 THEN 0.0 WHEN bio12 <= 500 THEN (bio12 - 100) / 400 * 10 WHEN bio12 <= 2000 THEN 10 + (bio12 - 500) / 1500 * 30 ELSE 40.0 END, 6) AS v FROM sites")
def interp_lookup(spark, sf_dir):
    return sites(spark, sf_dir).select(*KEYS, F.round(climate.interp(F.col("bio12"), [100, 500, 2000], [0, 10, 40]), 6).alias("v"))


@query(f"WITH {SITES}, q AS (SELECT list_transform(quantile_cont(bio12, [0.001, 0.25, 0.5, 0.75, 0.999]), lambda x: round(x, 6)) AS v FROM sites) SELECT v[1] AS q001, v[2] AS q25, v[3] AS q50, v[4] AS q75, v[5] AS q999 FROM q")
def quantile_table(spark, sf_dir):
    v = search.quantiles(sites(spark, sf_dir), "bio12", [0.001, 0.25, 0.5, 0.75, 0.999])
    return v.select(*[F.round(F.get("quantiles", F.lit(k)), 6).alias(n) for k, n in enumerate(("q001", "q25", "q50", "q75", "q999"))])


# ---- heights, packed maps, seasons ----------------------------------------------------------


def block_y_sql(h: mapping.HeightMap) -> str:
    b, k, span = h.blocks_per_metre, h.knee, max(1.0, h.headroom - h.knee)
    u = f"((elev_m * {b!r} - {k!r}) / {span!r})"
    return f"""WITH {SITES} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN elev_m >= 0 THEN {h.sea_level} + trunc(CASE WHEN elev_m * {b!r} <= {k!r} THEN elev_m * {b!r} ELSE {u} / ({u} + 1) * {span!r} + {k!r} END)
    ELSE greatest(2, {h.sea_level} - trunc((sqrt(greatest(0.0, -elev_m) + 10) - sqrt(10.0) + 1) * {h.ocean_scale!r})) END AS INT) AS block_y FROM sites"""


ISOTROPIC = mapping.HeightMap()
MANUAL = mapping.HeightMap(mode="manual", manual_metres_per_block=40.0)
CALIBRATED = mapping.HeightMap(mode="auto", peak_m=2500.0)


@query(block_y_sql(ISOTROPIC))
def elevation_block_y(spark, sf_dir):
    return sites(spark, sf_dir).select(*KEYS, ISOTROPIC.block_y(F.col("elev_m")).alias("block_y"))


@query(block_y_sql(MANUAL))
def elevation_block_y_manual(spark, sf_dir):
    return sites(spark, sf_dir).select(*KEYS, MANUAL.block_y(F.col("elev_m")).alias("block_y"))


@query(block_y_sql(CALIBRATED))
def elevation_block_y_calibrated(spark, sf_dir):
    return sites(spark, sf_dir).select(*KEYS, CALIBRATED.block_y(F.col("elev_m")).alias("block_y"))


@query(f"""WITH {SITES}, s AS (SELECT *, greatest(109, 60 + CAST(trunc(slope * 100) AS INT)) AS y FROM sites)
    SELECT l_orderkey, l_linenumber, CAST((CAST(greatest(0.0, least(255.0, round_even((bio1 + 20) * 4.25 + (y - 110) / 1.5, 0))) AS INT) << 16)
    + (CAST(greatest(0, least(255, 120 - trunc((y - 110) / 2.0) - 5 * greatest(0, least(8, 8 + 110 - y)))) AS INT) << 8) AS INT) AS packed FROM s""")
def pack_climate(spark, sf_dir):
    y = F.lit(60) + (F.col("slope") * 100).cast("int")
    return sites(spark, sf_dir).select(*KEYS, mapping.pack_climate(F.col("bio1"), F.lit(120), y, 110).alias("packed"))


@query(f"WITH {SITES}, p AS (SELECT *, CAST(greatest(0.0, least(255.0, round_even(greatest(0.0, bio4) / 100 * 8, 0))) AS INT) AS s, CAST(greatest(0.0, least(255.0, round_even(bio15, 0))) AS INT) AS c FROM sites) SELECT l_orderkey, l_linenumber, CAST(s * 65536 + c * 256 AS INT) AS packed, s / 8.0 AS sigma_c, c AS precip_cv FROM p")
def pack_seasonality(spark, sf_dir):
    rows = sites(spark, sf_dir).select(*KEYS, mapping.pack_seasonality(climate.sigma(F.col("bio4")), F.col("bio15")).alias("packed"))
    high, middle, _ = mapping.unpack(F.col("packed"))
    return rows.select("*", (high / 8.0).alias("sigma_c"), middle.alias("precip_cv"))


@query(f"WITH {BIO} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN elev_m <= 0 OR slope >= bare THEN 0 ELSE round_even(255 * {FOREST_SQL}, 0) END AS INT) AS forest, CAST(CASE WHEN elev_m <= 0 OR slope >= bare THEN 0 ELSE round_even(255 * {SHRUB_SQL}, 0) END AS INT) AS shrub, CAST(CASE WHEN elev_m >= 0 THEN 0 ELSE trunc(255 * least(1.0, -elev_m / 200)) END AS INT) AS ocean FROM bio")
def cover_bytes(spark, sf_dir):
    e, s, bare = F.col("elev_m"), F.col("slope"), F.col("b.bare_slope")
    return with_bio(spark, sf_dir).select(*KEYS, mapping.cover_byte(F.col("b.forest"), e, s, bare).alias("forest"), mapping.cover_byte(F.col("b.shrub"), e, s, bare).alias("shrub"), mapping.ocean_byte(e).alias("ocean"))


@query("WITH f AS (SELECT DISTINCT p_size / 50.0 AS f FROM part) SELECT f AS fraction, round(CASE WHEN f * 256 - 110 <= 0 THEN f ELSE least(1.0, (110 + (f * 256 - 110) * 1.5) / 256) END, 6) AS stretched FROM f")
def band_stretch(spark, sf_dir):
    f = table(spark, sf_dir, "part").select((F.col("p_size") / 50.0).alias("fraction")).distinct()
    return f.select("fraction", F.round(mapping.stretched_band(F.col("fraction"), 256, 110, 1.5), 6).alias("stretched"))


SEASON = SITES + """, m AS (SELECT *, ((days / 365.25) - floor(days / 365.25)) * 12 AS month FROM sites),
    c AS (SELECT *, abs((month - 0.5 + 18) - 12 * floor((month - 0.5 + 18) / 12) - 6) / 6 AS d FROM m),
    s AS (SELECT *, d * d * d * (d * (d * 6 - 15) + 10) AS summer FROM c)"""


@query(f"""WITH {SEASON}, h AS (SELECT *, abs((((days - floor(days)) * 24 - 4 + 36) - 24 * floor(((days - floor(days)) * 24 - 4 + 36) / 24)) - 12) / 12 AS p FROM s)
    SELECT l_orderkey, l_linenumber, round(bio1 + 2.8284271 * greatest(0.0, bio4) / 100 * (summer - 0.5) + (p * p * (3 - 2 * p) - 0.5) * (18 - 13 * 0.4), 5) AS temp_c FROM h""")
def seasonal_temperature(spark, sf_dir):
    t = seasons.seasonal_temperature(F.col("bio1"), climate.sigma(F.col("bio4")), F.lit(0.4), F.col("days"))
    return sites(spark, sf_dir).select(*KEYS, F.round(t, 5).alias("temp_c"))


@query(f"WITH {SEASON} SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, 0.4 * greatest(0.0, 1 + 1.4142136 * bio15 / 100 * (2 * summer - 1)))), 5) AS rainfall FROM s")
def seasonal_rainfall(spark, sf_dir):
    return sites(spark, sf_dir).select(*KEYS, F.round(seasons.seasonal_rainfall(F.lit(0.4), F.col("bio15"), F.col("days")), 5).alias("rainfall"))


# ---- lattice -------------------------------------------------------------------------------

W8 = grid.Windows(8, 6)
WINDOWED = CELLS + """, a AS (SELECT *, unnest(range(CAST(ceil((i - 7) / 6.0) AS BIGINT), CAST(floor(i / 6.0) AS BIGINT) + 1)) AS wi FROM cells),
    w AS (SELECT *, unnest(range(CAST(ceil((j - 7) / 6.0) AS BIGINT), CAST(floor(j / 6.0) AS BIGINT) + 1)) AS wj FROM a)"""


@query(f"WITH {WINDOWED} SELECT i, j, wi, wj, i - wi * 6 AS li, j - wj * 6 AS lj FROM w")
def window_assign(spark, sf_dir):
    return grid.to_windows(cells(spark, sf_dir), W8).select("i", "j", "wi", "wj", "li", "lj")


@query(f"""WITH {WINDOWED}, t AS (SELECT *, (1 - (1 - 1e-3) * least(1.0, abs(i - wi * 6 - 3.5) / 3.5)) * (1 - (1 - 1e-3) * least(1.0, abs(j - wj * 6 - 3.5) / 3.5)) AS wt FROM w)
    SELECT i, j, round(sum(elev_m * wt) / sum(wt), 4) AS elev_m, round(sum(wt), 6) AS weight FROM t GROUP BY i, j""")
def overlap_add(spark, sf_dir):
    wt = grid.tent(F.col("li"), 8) * grid.tent(F.col("lj"), 8)
    out = grid.overlap_add(grid.to_windows(cells(spark, sf_dir), W8), "elev_m", wt)
    return out.select("i", "j", F.round("elev_m", 4).alias("elev_m"), F.round("weight", 6).alias("weight"))


@query(f"WITH {WINDOWED} SELECT DISTINCT wi, wj FROM w WHERE (wi + wj) % 2 <> 0")
def pending_windows(spark, sf_dir):
    c = cells(spark, sf_dir)
    asked = c.select(F.col("i").alias("i0"), (F.col("i") + 1).alias("i1"), F.col("j").alias("j0"), (F.col("j") + 1).alias("j1"))
    cached = grid.to_windows(c, W8).where((F.col("wi") + F.col("wj")) % 2 == 0).select("wi", "wj").distinct()
    return grid.pending(asked, W8, cached)


@query(f"WITH {CELLS} SELECT CAST(floor(i / 16.0) AS BIGINT) AS tile_i, CAST(floor(j / 16.0) AS BIGINT) AS tile_j, count(*) AS n, round(min(elev_m), 4) AS low, round(max(elev_m), 4) AS high FROM cells GROUP BY 1, 2")
def tile_extremes(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.groupBy(grid.tile_of(F.col("i"), 16)[0].alias("tile_i"), grid.tile_of(F.col("j"), 16)[0].alias("tile_j")).agg(F.count("*").alias("n"), F.round(F.min("elev_m"), 4).alias("low"), F.round(F.max("elev_m"), 4).alias("high"))


@query(f"""WITH {CELLS}, o AS (SELECT unnest(range(-1, 2)) AS d), near AS (SELECT c.i - a.d AS ti, c.j - b.d AS tj, a.d AS di, b.d AS dj, elev_m FROM cells c, o a, o b)
    SELECT ti AS i, tj AS j, round(sqrt(pow(sum(elev_m * dj * CASE WHEN di = 0 THEN 2 ELSE 1 END) / 8, 2) + pow(sum(elev_m * di * CASE WHEN dj = 0 THEN 2 ELSE 1 END) / 8, 2)) / 15.0, 5) AS slope FROM near GROUP BY ti, tj HAVING count(*) = 9""")
def sobel_slope(spark, sf_dir):
    return raster.sobel_slope(cells(spark, sf_dir), "elev_m", 15.0).select("i", "j", F.round("slope", 5).alias("slope"))


@query(f"WITH {CELLS}, o AS (SELECT unnest(range(-1, 2)) AS d), near AS (SELECT c.i - a.d AS ti, c.j - b.d AS tj, elev_m FROM cells c, o a, o b) SELECT ti AS i, tj AS j FROM near GROUP BY ti, tj HAVING count(*) = 9 AND min(elev_m) > 0")
def land_erosion(spark, sf_dir):
    return raster.land_erosion(cells(spark, sf_dir), "elev_m")


KERNEL = "k AS (SELECT d, exp(-d * d / 50.0) / sum(exp(-d * d / 50.0)) OVER () AS w FROM (SELECT unnest(range(-5, 6)) AS d))"


@query(f"""WITH {CELLS}, {KERNEL}, n AS (SELECT max(i) AS mi, max(j) AS mj FROM cells),
    a AS (SELECT t.i, t.j, sum(s.elev_m * k.w) AS v FROM cells t, k, n, cells s WHERE s.i = t.i AND s.j = greatest(0, least(n.mj, t.j + k.d)) GROUP BY t.i, t.j)
    SELECT t.i, t.j, round(sum(s.v * k.w), 4) AS elev_m FROM a t, k, n, a s WHERE s.j = t.j AND s.i = greatest(0, least(n.mi, t.i + k.d)) GROUP BY t.i, t.j""")
def gaussian_blur(spark, sf_dir):
    c = cells(spark, sf_dir)
    return raster.gaussian_blur(c, "elev_m", grid_rows(c), 50).select("i", "j", F.round("elev_m", 4).alias("elev_m"))


def bilinear_sql(tail: str) -> str:
    axis = lambda a, n, to: f"r{a} AS (SELECT t, s - floor(s) AS f, greatest(0, least({n} - 1, CAST(floor(s) AS BIGINT))) AS a0, greatest(0, least({n} - 1, CAST(floor(s) AS BIGINT) + 1)) AS a1 FROM (SELECT t, (t + 0.5) * {n} / {to} - 0.5 AS s FROM (SELECT unnest(range({to})) AS t)))"
    return f"""WITH {CELLS}, {axis("i", ROWS, f"({ROWS} * 2)")}, {axis("j", 50, 75)},
    up AS (SELECT ri.t AS i, rj.t AS j, (1 - ri.f) * (1 - rj.f) * c00.elev_m + (1 - ri.f) * rj.f * c01.elev_m + ri.f * (1 - rj.f) * c10.elev_m + ri.f * rj.f * c11.elev_m AS v
    FROM ri, rj JOIN cells c00 ON c00.i = ri.a0 AND c00.j = rj.a0 JOIN cells c01 ON c01.i = ri.a0 AND c01.j = rj.a1 JOIN cells c10 ON c10.i = ri.a1 AND c10.j = rj.a0 JOIN cells c11 ON c11.i = ri.a1 AND c11.j = rj.a1) {tail}"""


@query(bilinear_sql("SELECT i, j, round(v, 4) AS elev_m FROM up"))
def bilinear_resize(spark, sf_dir):
    c = cells(spark, sf_dir)
    n = grid_rows(c)
    return raster.bilinear_resize(c, "elev_m", n, 50, 2 * n, 75).select("i", "j", F.round("elev_m", 4).alias("elev_m"))


@query(bilinear_sql("SELECT i, j, round(v + (i - j) * 0.5, 4) AS elev_m FROM up"))
def laplacian_decode(spark, sf_dir):
    c = cells(spark, sf_dir)
    n = grid_rows(c)
    fine = spark.range(2 * n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(74).cast("long"))).alias("j")).withColumn("elev_m", (F.col("i") - F.col("j")) * 0.5)
    out = raster.laplacian_decode(fine, c.select("i", "j", "elev_m"), "elev_m", (n, 50), (2 * n, 75))
    return out.select("i", "j", F.round("elev_m", 4).alias("elev_m"))


@query(f"WITH {CELLS}, a AS (SELECT unnest(range({ROWS} * 2)) AS t), b AS (SELECT unnest(range(75)) AS t) SELECT a.t AS i, b.t AS j, round(elev_m, 4) AS elev_m FROM a, b JOIN cells c ON c.i = CAST(floor(a.t / 2.0) AS BIGINT) AND c.j = CAST(floor(b.t * 50 / 75.0) AS BIGINT)")
def nearest_upsample(spark, sf_dir):
    c = cells(spark, sf_dir)
    n = grid_rows(c)
    return raster.nearest_upsample(c, n, 50, 2 * n, 75).select("i", "j", F.round("elev_m", 4).alias("elev_m"))


@query(f"""WITH {CELLS}, o AS (SELECT unnest(range(-7, 8)) AS d), near AS (SELECT c.i - a.d AS ti, c.j - b.d AS tj, a.d = 0 AND b.d = 0 AS mid, elev_m AS e, temp_c AS t, CASE WHEN elev_m > 0 THEN 1.0 ELSE 0.0 END AS land FROM cells c, o a, o b),
    s AS (SELECT ti, tj, sum(land) AS w, sum(land) + 1e-6 AS den, sum(t * land) AS st, sum(e * land) AS se, sum(e * e * land) AS see, sum(e * t * land) AS set_, max(CASE WHEN mid THEN t END) AS tc, max(CASE WHEN mid THEN e END) AS ec FROM near GROUP BY ti, tj HAVING count(*) = 225),
    m AS (SELECT *, see / den - se / den * (se / den) AS var, set_ / den - se / den * (st / den) AS cov FROM s),
    b AS (SELECT *, greatest(-0.012, least(0.0, CASE WHEN var < 1 OR w < 0.02 * 225 THEN -0.0065 ELSE cov / (var + 1e-6) END)) AS beta FROM m)
    SELECT ti AS i, tj AS j, round(tc - beta * ec, 4) AS base, round(beta, 6) AS beta FROM b""")
def local_lapse(spark, sf_dir):
    return raster.local_lapse(cells(spark, sf_dir), "temp_c", "elev_m").select("i", "j", F.round("base", 4).alias("base"), F.round("beta", 6).alias("beta"))


R_AXIS = "r{a} AS (SELECT t, s - floor(s) AS f, greatest(0, least({n} - 1, CAST(floor(s) AS BIGINT))) AS a0, greatest(0, least({n} - 1, CAST(floor(s) AS BIGINT) + 1)) AS a1 FROM (SELECT t, (t + 0.5) * {n} / {to} - 0.5 AS s FROM (SELECT unnest(range({to})) AS t)))"


@query(f"""WITH {CELLS}, p1 AS (SELECT i, j, elev_m AS v FROM cells
      UNION ALL SELECT -1, j, sum(CASE WHEN i = 0 THEN 2 * elev_m ELSE -elev_m END) FROM cells WHERE i <= 1 GROUP BY j
      UNION ALL SELECT {ROWS}, j, sum(CASE WHEN i = {ROWS} - 1 THEN 2 * elev_m ELSE -elev_m END) FROM cells WHERE i >= {ROWS} - 2 GROUP BY j),
    p2 AS (SELECT * FROM p1
      UNION ALL SELECT i, -1, sum(CASE WHEN j = 0 THEN 2 * v ELSE -v END) FROM p1 WHERE j <= 1 GROUP BY i
      UNION ALL SELECT i, 50, sum(CASE WHEN j = 49 THEN 2 * v ELSE -v END) FROM p1 WHERE j >= 48 GROUP BY i),
    pad AS (SELECT i + 1 AS i, j + 1 AS j, v FROM p2), {R_AXIS.format(a="i", n=f"({ROWS} + 2)", to=f"({ROWS} * 2 + 4)")}, {R_AXIS.format(a="j", n=52, to=78)}
    SELECT ri.t - 2 AS i, rj.t - 2 AS j, round((1 - ri.f) * (1 - rj.f) * c00.v + (1 - ri.f) * rj.f * c01.v + ri.f * (1 - rj.f) * c10.v + ri.f * rj.f * c11.v, 4) AS elev_m
    FROM ri, rj JOIN pad c00 ON c00.i = ri.a0 AND c00.j = rj.a0 JOIN pad c01 ON c01.i = ri.a0 AND c01.j = rj.a1 JOIN pad c10 ON c10.i = ri.a1 AND c10.j = rj.a0 JOIN pad c11 ON c11.i = ri.a1 AND c11.j = rj.a1
    WHERE ri.t BETWEEN 2 AND {ROWS} * 2 + 1 AND rj.t BETWEEN 2 AND 76""")
def extrapolated_resize(spark, sf_dir):
    c = cells(spark, sf_dir)
    n = grid_rows(c)
    return borders.resize_extrapolated(c, "elev_m", n, 50, 2 * n, 75).select("i", "j", F.round("elev_m", 4).alias("elev_m"))


@query(f"""WITH {CELLS}, ch AS (SELECT CAST(floor(j / 4.0) AS BIGINT) AS cx, CAST(floor(i / 4.0) AS BIGINT) AS cz, j % 4 AS x, i % 4 AS z, elev_m AS h FROM cells),
    g AS (SELECT * FROM ch WHERE (cx + 3 * cz) % 7 = 0), gc AS (SELECT DISTINCT cx, cz FROM g), r AS (SELECT DISTINCT cx, cz FROM ch WHERE (cx + 3 * cz) % 7 <> 0),
    d AS (SELECT dx, dz FROM (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dz) WHERE dx <> 0 OR dz <> 0),
    near AS (SELECT r.cx, r.cz, dx, dz FROM r, d JOIN gc ON gc.cx = r.cx + dx AND gc.cz = r.cz + dz),
    kept AS (SELECT * FROM near n WHERE dx = 0 OR dz = 0 OR NOT EXISTS (SELECT 1 FROM near m WHERE m.cx = n.cx AND m.cz = n.cz AND ((m.dx = n.dx AND m.dz = 0) OR (m.dx = 0 AND m.dz = n.dz)))),
    t AS (SELECT kept.*, x, z, CASE dx WHEN 0 THEN x WHEN 1 THEN 0 ELSE 3 END AS hx, CASE dz WHEN 0 THEN z WHEN 1 THEN 0 ELSE 3 END AS hz,
      CASE dx WHEN 0 THEN 0.0 WHEN 1 THEN 1 - (x + 1) / 4.0 ELSE x / 4.0 END + CASE dz WHEN 0 THEN 0.0 WHEN 1 THEN 1 - (z + 1) / 4.0 ELSE z / 4.0 END AS gap
      FROM kept, (SELECT unnest(range(4)) AS x), (SELECT unnest(range(4)) AS z)),
    v AS (SELECT t.cx, t.cz, t.x, t.z, g.h, power(greatest(0.0, 1 - gap), 2) AS w FROM t JOIN g ON g.cx = t.cx + dx AND g.cz = t.cz + dz AND g.x = hx AND g.z = hz)
    SELECT cx, cz, x, z, round(sum((h + 0.5) * greatest(0.0001, w)) / greatest(0.0001, sum(w)), 4) AS y, round(CAST(max(w) AS DOUBLE), 6) AS weight FROM v GROUP BY cx, cz, x, z""")
def border_taper(spark, sf_dir):
    part = lambda c: F.floor(F.col(c) / 4).cast("long")
    ch = cells(spark, sf_dir).select(part("j").alias("cx"), part("i").alias("cz"), (F.col("j") % 4).alias("x"), (F.col("i") % 4).alias("z"), F.col("elev_m").alias("height"))
    done = (F.col("cx") + 3 * F.col("cz")) % 7 == 0
    out = borders.border_taper(ch.where(done), ch.where(~done), size=4)
    return out.select("cx", "cz", F.col("x").cast("long").alias("x"), F.col("z").cast("long").alias("z"), F.round("y", 4).alias("y"), F.round("weight", 6).alias("weight"))


# ---- searches ------------------------------------------------------------------------------

BAND_SQL = "bands(code, min_c, max_c) AS (VALUES ('hot', 28.0, 32.0), ('warm', 19.0, 23.0), ('temperate', 6.0, 14.0), ('cool', -5.0, 1.0), ('icy', -15.0, -10.0))"


@query(f"WITH {SITES}, {BAND_SQL} SELECT l_orderkey, l_linenumber, code FROM sites LEFT JOIN bands ON bio1 BETWEEN min_c AND max_c")
def starting_band_join(spark, sf_dir):
    return search.with_band(sites(spark, sf_dir), "bio1").select(*KEYS, "code")


@query(f"WITH {SITES} SELECT l_orderkey, l_linenumber, greatest(6.0 - bio1, bio1 - 14.0, 0.0) AS miss FROM sites")
def band_miss(spark, sf_dir):
    return sites(spark, sf_dir).select(*KEYS, search.band_miss(F.col("bio1"), F.lit(6.0), F.lit(14.0)).alias("miss"))


@query(f"WITH {CELLS}, land AS (SELECT elev_m, row_number() OVER (ORDER BY elev_m DESC) - 1 AS k, count(*) OVER () AS n FROM cells WHERE elev_m > 0) SELECT elev_m FROM land WHERE k = least(CAST(floor(n * (1 - 0.995)) AS BIGINT), n - 1)")
def peak_survey(spark, sf_dir):
    return search.tail_order_statistic(cells(spark, sf_dir).where("elev_m > 0"), "elev_m", 0.995)


PLACED = CELLS + f""", p AS (SELECT *, i - CAST(floor({ROWS} / 2.0) AS BIGINT) AS dr, j - 25 AS dc FROM cells WHERE elev_m > 0),
    x AS (SELECT *, CASE WHEN dr BETWEEN -7 AND 6 AND dc BETWEEN -7 AND 6 THEN 16 WHEN dr BETWEEN -15 AND 14 AND dc BETWEEN -15 AND 14 THEN 32 WHEN dr BETWEEN -31 AND 30 AND dc BETWEEN -31 AND 30 THEN 64 WHEN dr BETWEEN -63 AND 62 AND dc BETWEEN -63 AND 62 THEN 128 END AS box,
    CAST(4 * dr * dr + dc * dc AS DOUBLE) AS cost FROM p)"""


def around(spark, sf_dir):
    c = cells(spark, sf_dir)
    mid = grid_rows(c) // 2
    return c.where("elev_m > 0").withColumn("dr", F.col("i") - mid).withColumn("dc", F.col("j") - 25)


@query(f"WITH {PLACED} SELECT box, count(*) AS n, min(cost) AS cost FROM x WHERE box IS NOT NULL GROUP BY box")
def nested_boxes(spark, sf_dir):
    return search.nested_boxes(around(spark, sf_dir), "dr", "dc").groupBy("box").agg(F.count("*").alias("n"), F.min("cost").alias("cost"))


@query(f"WITH {PLACED} SELECT i, j, temp_c, box, cost FROM x WHERE box IS NOT NULL AND temp_c BETWEEN 6 AND 14 ORDER BY box, cost, dr, dc LIMIT 1")
def spawn_band(spark, sf_dir):
    return search.find_spawn(around(spark, sf_dir), 6.0, 14.0).select("i", "j", "temp_c", "box", "cost")


@query(f"WITH {PLACED} SELECT i, j, temp_c, greatest(90 - temp_c, temp_c - 95, 0.0) AS miss FROM x WHERE box IS NOT NULL ORDER BY miss, cost, box, dr, dc LIMIT 1")
def spawn_fallback(spark, sf_dir):
    return search.find_spawn(around(spark, sf_dir), 90.0, 95.0).select("i", "j", "temp_c", "miss")


@query(f"WITH {PLACED} SELECT i, j, cost FROM x WHERE box IS NOT NULL ORDER BY cost, dr, dc LIMIT 4")
def spawn_shortlist(spark, sf_dir):
    return search.best(search.nested_boxes(around(spark, sf_dir), "dr", "dc"), ["cost", "dr", "dc"], 4).select("i", "j", "cost")


@query(f"""WITH {CELLS}, r AS (SELECT i, j, elev_m, row_number() OVER (ORDER BY elev_m DESC, i, j) - 1 AS k, greatest(1, CAST(trunc(count(*) OVER () * 0.25) AS BIGINT)) AS pool FROM cells)
    SELECT p.probe, i, j, elev_m FROM (SELECT unnest(range(8)) AS probe) p JOIN r ON r.k = CAST(floor(p.probe * r.pool / 8.0) AS BIGINT)""")
def probe_pool(spark, sf_dir):
    return search.probes(cells(spark, sf_dir).select("i", "j", "elev_m"), "elev_m", ["i", "j"], 8)


@query("WITH w AS (SELECT event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS seen FROM events) SELECT event_id, CAST(len(list_filter(seen, lambda x: x = event_type)) AS INT) AS repeats FROM w")
def thrash_window(spark, sf_dir):
    return search.repeats_in_last(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], partition="user_id").select("event_id", "repeats")


# ---- voxels --------------------------------------------------------------------------------

GROUND = CELLS + ", g AS (SELECT *, CAST(8 + trunc(abs(elev_m) / 200) AS INT) AS surface_y FROM cells)"


def ground(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("surface_y", F.lit(8) + (F.abs("elev_m") / 200).cast("int"))


VOXELS = GROUND + """, v AS (SELECT *, unnest(range(0, greatest(surface_y, 19) + 1)) AS y FROM g),
    f AS (SELECT *, CASE WHEN y = 0 THEN 'mantle' WHEN y <= surface_y THEN 'rock' END AS block,
    CASE WHEN y > surface_y THEN CASE WHEN y = 19 AND temp_c < -10 AND elev_m >= 0 THEN 'lakeice' WHEN elev_m < 0 THEN 'saltwater' ELSE 'water' END END AS fluid FROM v)"""


def filled(spark, sf_dir):
    return voxel.fill_columns(ground(spark, sf_dir), 20, ocean=F.col("elev_m") < 0, freezes=F.col("temp_c") < -10)


@query(f"WITH {VOXELS} SELECT block, fluid, CAST(y AS INT) AS y, count(*) AS n FROM f GROUP BY ALL")
def voxel_fill(spark, sf_dir):
    return filled(spark, sf_dir).groupBy("block", "fluid", "y").agg(F.count("*").alias("n"))


@query(f"WITH {VOXELS} SELECT i, j, CAST(y AS INT) AS y FROM f WHERE temp_c < -12 AND y > surface_y - 3 AND y <= surface_y AND block IS NOT NULL")
def glacier_cap(spark, sf_dir):
    return voxel.glacier_cap(filled(spark, sf_dir), F.col("temp_c") < -12).where("block = 'glacierice'").select("i", "j", "y")


@query(f"""WITH {VOXELS}, soft AS (SELECT i, j, CAST(y AS INT) AS y, temp_c, surface_y, CASE WHEN y > surface_y - 4 AND (i + j + y) % 7 <> 0 THEN 'soil' ELSE block END AS block FROM f),
    d AS (SELECT *, max(CASE WHEN y <= surface_y AND coalesce(block, 'air') NOT IN ('soil', 'gravel', 'sand') THEN 1 ELSE 0 END) OVER (PARTITION BY i, j ORDER BY y DESC ROWS UNBOUNDED PRECEDING) AS stop FROM soft)
    SELECT i, j, y FROM d WHERE temp_c > 20 AND y <= surface_y AND y > surface_y - 12 AND stop = 0""")
def scour_to_rock(spark, sf_dir):
    soft = filled(spark, sf_dir).withColumn("block", F.when((F.col("y") > F.col("surface_y") - 4) & ((F.col("i") + F.col("j") + F.col("y")) % 7 != 0), "soil").otherwise(F.col("block")))
    before = soft.withColumn("was", F.col("block"))
    return voxel.scour(before, F.col("temp_c") > 20, ["i", "j"]).where("block = 'rock' and was = 'soil'").select("i", "j", "y")


@query(f"WITH {GROUND} SELECT CAST(floor(i / 32.0) AS BIGINT) AS chunk_i, CAST(floor(j / 32.0) AS BIGINT) AS chunk_j, max(greatest(1, least(254, greatest(surface_y, 19)))) AS y_max FROM g GROUP BY 1, 2")
def chunk_heights(spark, sf_dir):
    g = ground(spark, sf_dir).withColumn("rain", voxel.rain_height(F.col("surface_y"), 20, 256))
    return g.groupBy(grid.tile_of(F.col("i"), 32)[0].alias("chunk_i"), grid.tile_of(F.col("j"), 32)[0].alias("chunk_j")).agg(F.max("rain").alias("y_max"))


# ---- generation ----------------------------------------------------------------------------


@query("""WITH s AS (SELECT n AS step, CASE WHEN n = 20 THEN 0.0 ELSE pow(pow(80.0, 1 / 7.0) + n / 19.0 * (pow(0.002, 1 / 7.0) - pow(80.0, 1 / 7.0)), 7) END AS sigma FROM (SELECT unnest(range(21)) AS n))
    SELECT vec_id, step, round(sigma, 6) AS sigma, round(list_sum(embedding::DOUBLE[]) * sigma, 4) + 0.0 AS noised FROM embeddings JOIN s ON step = vec_id % 21""")
def karras_sigmas(spark, sf_dir):
    """Every vector at the noise level of a step of its own."""
    steps = diffusion.karras_sigmas(spark, 20)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 21).alias("step"), total.alias("total")).join(F.broadcast(steps), "step")  # 21 rows
    return rows.select("vec_id", "step", F.round("sigma", 6).alias("sigma"), (F.round(F.col("total") * F.col("sigma"), 4) + F.lit(0.0)).alias("noised"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: 0.25 * CAST(x AS DOUBLE) + 0.75 * 0.5)), 4) AS total FROM embeddings")
def solver_step(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = diffusion.first_order(v, F.transform("embedding", lambda x: F.lit(0.5)), 4.0, 1.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"""WITH {SITES}, p AS (SELECT l_orderkey, l_linenumber, bio1 AS x, slope AS f, 1 + bio4 / 100 AS sigma FROM sites)
    SELECT l_orderkey, l_linenumber, round(x / sqrt(1.6 * 1.6 + 0.25), 6) AS scaled, round(atan(1.6 / 0.5), 6) AS label, round(0.25 / (sigma * sigma + 0.25) * x + sigma * 0.5 / sqrt(sigma * sigma + 0.25) * f, 6) AS clean FROM p""")
def preconditioning(spark, sf_dir):
    x, sigma = F.col("bio1"), 1 + F.col("bio4") / 100
    return sites(spark, sf_dir).select(*KEYS, F.round(diffusion.scaled_input(x, 1.6), 6).alias("scaled"), F.round(F.lit(diffusion.noise_label(1.6)), 6).alias("label"), F.round(diffusion.denoised(x, sigma, F.col("slope")), 6).alias("clean"))


@query("""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, x, 0.3 * x + 0.1 AS m, 0.2 * x - 0.05 AS before FROM p)
    SELECT vec_id, round(sum(0.25 * x + 0.75 * (m + 0.5 * (m - before) * (ln(4.0) - ln(1.0)) / (ln(9.0) - ln(4.0)))), 4) AS total FROM c GROUP BY vec_id""")
def second_order_step(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = diffusion.second_order(v, F.transform(v, lambda x: x * 0.3 + 0.1), F.transform(v, lambda x: x * 0.2 - 0.05), 9.0, 4.0, 1.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


ATTRIBUTE_SQL = "CASE o_orderkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN o_orderpriority WHEN 2 THEN NULL ELSE ' ' || (o_orderkey % 1000) || '.5 ' END"


@query(f"SELECT o_orderkey, coalesce(TRY_CAST(nullif(trim({ATTRIBUTE_SQL}), '') AS DOUBLE), 1.0) AS scale, coalesce(nullif(trim({ATTRIBUTE_SQL}), ''), 'isotropic') AS mode FROM orders")
def world_attributes(spark, sf_dir):
    n = F.col("o_orderkey")
    found = F.when(n % 4 == 0, "  ").when(n % 4 == 1, F.col("o_orderpriority")).when(n % 4 == 3, F.concat(F.lit(" "), (n % 1000).cast("string"), F.lit(".5 ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", settings.typed(found, "double", 1.0).alias("scale"), settings.typed(found, "string", "isotropic").alias("mode"))


def step_sql(state: str) -> str:
    return f"CAST((CAST({state} AS UHUGEINT) * {noise.MULTIPLIER} + {noise.INCREMENT}) % {noise.MASK + 1} AS UBIGINT)"


def output_sql(state: str) -> str:
    """2 (r + 1) / 2^32 - 1 of the 32-bit output r of a state."""
    x, rot = f"(CAST(xor({state} >> 18, {state}) >> 27 AS UBIGINT) & 4294967295)", f"({state} >> 59)"
    return f"(2.0 * (((({x} >> {rot}) | ({x} << ((32 - {rot}) & 31))) & 4294967295) + 1) / 4294967296.0 - 1)"


#: 2,048 pairs that pass lie within the first 2,900 of a tile but for a chance of 10^-20 or so.
@query(f"""WITH RECURSIVE {CELLS}, c AS (SELECT i - 20 AS i, j - 30 AS j FROM cells), t AS (SELECT DISTINCT CAST(floor(i / 64.0) AS BIGINT) AS ti, CAST(floor(j / 64.0) AS BIGINT) AS tj FROM c),
    h AS (SELECT ti, tj, (CAST(1234 AS UHUGEINT) * {noise.GOLDEN} + CAST(ti & 4294967295 AS UHUGEINT)) % {noise.MASK + 1} AS h FROM t),
    seeds AS (SELECT ti, tj, CAST((h * {noise.GOLDEN} + CAST(tj & 4294967295 AS UHUGEINT)) % {noise.MASK + 1} AS UBIGINT) AS s FROM h),
    walk AS (SELECT ti, tj, 0 AS n, CAST(0 AS UBIGINT) AS s1, s AS s2 FROM seeds UNION ALL SELECT ti, tj, n + 1, {step_sql("s2")}, {step_sql(step_sql("s2"))} FROM walk WHERE n < 2900),
    u AS (SELECT ti, tj, n, {output_sql("s1")} AS a, {output_sql("s2")} AS b FROM walk WHERE n > 0), q AS (SELECT *, a * a + b * b AS s FROM u),
    kept AS (SELECT *, sqrt(-2 * ln(s) / s) AS f, row_number() OVER (PARTITION BY ti, tj ORDER BY n) - 1 AS k FROM q WHERE s > 0 AND s < 1),
    z AS (SELECT ti, tj, 2 * k AS place, a * f AS noise FROM kept UNION ALL SELECT ti, tj, 2 * k + 1, b * f FROM kept),
    g AS (SELECT ti * 64 + place // 64 AS i, tj * 64 + place % 64 AS j, noise FROM z WHERE place < 4096)
    SELECT i, j, round(CAST(CAST(noise AS FLOAT) AS DOUBLE), 4) + 0.0 AS noise FROM g JOIN c USING (i, j)""")
def gaussian_noise(spark, sf_dir):
    placed = cells(spark, sf_dir).select((F.col("i") - 20).alias("i"), (F.col("j") - 30).alias("j"))
    return noise.with_gaussian(placed, 1234).select("i", "j", (F.round(F.col("noise").cast("double"), 4) + F.lit(0.0)).alias("noise"))


def noises_sql(**named: str) -> str:
    """(i, j, one column for each subquery), rounded."""
    joins = " ".join(f"JOIN {q} AS t{k} USING (i, j)" for k, q in enumerate(named.values()))
    return f"WITH {CELLS} SELECT i, j, {', '.join(f'round(t{k}.noise, 6) + 0.0 AS {name}' for k, name in enumerate(named))} FROM cells {joins}"


def with_noises(rows: DataFrame, **named) -> DataFrame:
    return rows.select("i", "j", *[(F.round(f("i", "j"), 6) + F.lit(0.0)).alias(k) for k, f in named.items()])


@query(noises_sql(noise=noise_sql("gradient", 99999, 1 / 24, 3), fine=noise_sql("gradient", 88888, 1 / 6, 2, 0.6)))
def perlin_fbm(spark, sf_dir):
    return with_noises(cells(spark, sf_dir), noise=noise.fbm_column(99999, 1 / 24, 3), fine=noise.fbm_column(88888, 1 / 6, 2, gain=0.6))


RIDGED, PING_PONG = "1 - 2 * abs(n)", "1 - 2 * abs((n + 1) * 2 - 2 * floor((n + 1) * 2 / 2) - 1)"


@query(noises_sql(value=noise_sql("value", 11, 1 / 16, 3), ridged=noise_sql("gradient", 13, 1 / 24, 3, fold=RIDGED), ping_pong=noise_sql("gradient", 14, 1 / 24, 2, fold=PING_PONG), simplex=noise_sql("simplex", 15, 1 / 16, 3)))
def noise_fields(spark, sf_dir):
    column = fields.field_column
    return with_noises(cells(spark, sf_dir), value=column("value", 11, 1 / 16, 3), ridged=column("gradient", 13, 1 / 24, 3, "ridged"), ping_pong=column("gradient", 14, 1 / 24, 2, "ping_pong"), simplex=column("simplex", 15, 1 / 16, 3))


@query(noises_sql(cellular=cellular_sql(12, 1 / 8), cubic=noise_sql("value_cubic", 16, 1 / 16, 2), smooth=weighted_sql("simplex_smooth", 17, 1 / 16, 0.5), warped=warped_sql(15, 1 / 24, 2, 6.0)))
def cellular_fields(spark, sf_dir):
    column = fields.field_column
    return with_noises(cells(spark, sf_dir), cellular=column("cellular", 12, 1 / 8), cubic=column("value_cubic", 16, 1 / 16, 2), smooth=column("simplex_smooth", 17, 1 / 16, 2, weighted=0.5), warped=column("gradient", 15, 1 / 24, 2, warp=6.0))


MULTIPLIERS = [1.0, 0.5, 1.0, 2.0, 1.5]


@query(noises_sql(**{name: noise_sql("gradient", 4242 + k + 1, noise.BANK_FREQUENCY * m, octaves) for k, ((name, octaves), m) in enumerate(zip(noise.BANK.items(), MULTIPLIERS, strict=True))}))
def noise_bank(spark, sf_dir):
    rows = noise.noise_bank(cells(spark, sf_dir).select("i", "j"), 4242, MULTIPLIERS)
    return rows.select("i", "j", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in noise.BANK])


@query(f"""WITH {CELLS} SELECT i, j, CAST(CASE WHEN elev_m <= 0 THEN 0 ELSE greatest(0.0, least(255.0, round_even((0.6 * 0.9 + 0.18 * noise * 0.6 * 0.9) * 255, 0))) END AS INT) AS cover
    FROM cells JOIN {noise_sql("gradient", 777, 32 / 480, 3)} AS t USING (i, j)""")
def forest_variation(spark, sf_dir):
    # a cell is 32 blocks wide, and the stand's noise has a frequency of 1 / 480 blocks
    variation = noise.fbm_column(777, 1 / 480, 3)(F.col("i") * 32, F.col("j") * 32)
    return cells(spark, sf_dir).select("i", "j", mapping.cover_byte(F.lit(0.6), F.col("elev_m"), F.lit(0.0), F.lit(1.0), 0.9, variation).alias("cover"))


from orograph.plans import tiled  # noqa: E402, F401  registers queries that share the SQL of those above
