"""Queries over tiles as rows of arrays, over time and over streams; imported after the queries whose SQL they share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.operators import composers, diffusion, fields, grid, noise, raster, search, tileframes, voxel
from orograph.operators.tiles import assemble
from orograph.plans.shared import CELLS, KEYS, ORACLE_SQL, ROWS, SITES, grid_rows, query, rounded
from orograph.plans.worlds import HEIGHTS, block_y_of
from orograph.sources import chunks
from orograph.sources.chunks import scratch
from orograph.sources.tables import cells, sites, table
from orograph.streaming import recent

# ---- tiles ------------------------------------------------------------------------------------


def tiles(spark: SparkSession, sf_dir: str, *values: str) -> tileframes.TileFrame:
    return tileframes.to_tiles(cells(spark, sf_dir), list(values), 16)


@query(ORACLE_SQL["sobel_slope"])
def tile_sobel(spark, sf_dir):
    return tileframes.sobel_slope(tiles(spark, sf_dir, "elev_m"), 15.0).cells().select("i", "j", F.round("slope", 5).alias("slope"))


@query(ORACLE_SQL["land_erosion"])
def tile_erosion(spark, sf_dir):
    return tileframes.land_erosion(tiles(spark, sf_dir, "elev_m")).cells().select("i", "j")


@query(ORACLE_SQL["gaussian_blur"])
def tile_blur(spark, sf_dir):
    made = tileframes.gaussian_blur(tiles(spark, sf_dir, "elev_m"), grid_rows(cells(spark, sf_dir)), 50)
    return made.cells().select("i", "j", F.round("elev_m", 4).alias("elev_m"))


@query(ORACLE_SQL["local_lapse"])
def tile_lapse(spark, sf_dir):
    made = tileframes.local_lapse(tiles(spark, sf_dir, "temp_c", "elev_m"))
    return made.cells().select("i", "j", (F.round("base", 4)).alias("base"), F.round("beta", 6).alias("beta"))


@query(f"WITH {CELLS} SELECT i, j, round(elev_m, 4) AS elev_m, temp_c FROM cells")
def tile_unpacked(spark, sf_dir):
    """Tiles back to cells by a table function, a partition for each tile."""
    return tileframes.unpacked(tiles(spark, sf_dir, "elev_m", "temp_c")).select("i", "j", F.round("elev_m", 4).alias("elev_m"), "temp_c")


@query(f"""WITH {CELLS}, t AS (SELECT a.v AS i, b.v AS j FROM (SELECT unnest(range({ROWS} + 12)) AS v) a, (SELECT unnest(range(61)) AS v) b)
    SELECT t.i, t.j, round(elev_m, 4) AS elev_m FROM t JOIN cells c ON c.i = greatest(0, least({ROWS} - 1, t.i - 5)) AND c.j = greatest(0, least(49, t.j + 3))""")
def clamped_crop(spark, sf_dir):
    c = cells(spark, sf_dir)
    n = grid_rows(c)
    return grid.clamped_crop(c.select("i", "j", "elev_m"), -5, 3, n + 12, 61, n, 50).select("i", "j", F.round("elev_m", 4).alias("elev_m"))


# ---- codes and guards ---------------------------------------------------------------------------

CODE = "CASE o_orderkey % 7 WHEN 0 THEN ' Hot' WHEN 1 THEN 'WARM  ' WHEN 2 THEN 'temperate' WHEN 3 THEN '  ' WHEN 4 THEN NULL WHEN 5 THEN o_orderpriority ELSE 'icY' END"


@query(f"SELECT o_orderkey, CASE WHEN lower(trim({CODE})) IN ('hot', 'warm', 'temperate', 'cool', 'icy') THEN lower(trim({CODE})) END AS code FROM orders")
def starting_code(spark, sf_dir):
    n = F.col("o_orderkey") % 7
    given = F.when(n == 0, " Hot").when(n == 1, "WARM  ").when(n == 2, "temperate").when(n == 3, "  ").when(n == 5, F.col("o_orderpriority")).when(n == 6, "icY")
    return table(spark, sf_dir, "orders").select("o_orderkey", search.parsed_code(given).alias("code"))


@query(f"WITH {SITES}, y AS (SELECT l_orderkey, l_linenumber, CAST(trunc(elev_m / 20) AS INT) AS surface_y FROM sites) SELECT * FROM y WHERE surface_y > 0 AND surface_y < 255")
def surface_guard(spark, sf_dir):
    rows = sites(spark, sf_dir).select(*KEYS, (F.col("elev_m") / 20).cast("int").alias("surface_y"))
    return rows.where(voxel.buildable(F.col("surface_y"), 256))


# ---- the solver over a table's predictions --------------------------------------------------------

STEPS = 12


@query(f"""WITH RECURSIVE p AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS e FROM embeddings),
    s AS (SELECT n, CASE WHEN n = {STEPS} THEN 0.0 ELSE pow(pow(80.0, 1 / 7.0) + n / {STEPS - 1}.0 * (pow(0.002, 1 / 7.0) - pow(80.0, 1 / 7.0)), 7) END AS s FROM (SELECT unnest(range({STEPS + 1})) AS n)),
    c AS (SELECT a.n, a.s, b.s / a.s AS r, CASE WHEN a.n IN (0, {STEPS - 1}) THEN 0.0 ELSE 0.5 * ln(a.s / b.s) / ln(z.s / a.s) END AS share FROM s a JOIN s b ON b.n = a.n + 1 LEFT JOIN s z ON z.n = a.n - 1),
    f AS (SELECT vec_id, k, e, CAST(0 AS BIGINT) AS n, e * (SELECT s FROM s WHERE n = 0) AS x, 0.0::DOUBLE AS before FROM p UNION ALL
      SELECT vec_id, k, e, n + 1, x * r - (m + (m - before) * share) * (r - 1), m FROM (SELECT f.*, c.r, c.share, 0.25 / (c.s * c.s + 0.25) * x + c.s * 0.5 / sqrt(c.s * c.s + 0.25) * (e * (0.1 * c.n - 0.4) + 0.05) AS m FROM f JOIN c ON c.n = f.n) q)
    SELECT vec_id, round(sum(x), 4) + 0.0 AS total, round(sum(x * x), 4) AS energy FROM f WHERE n = {STEPS} GROUP BY vec_id""")
def solver_fold(spark, sf_dir):
    """Twelve steps from each vector as noise, with predictions that the table gives for each step."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    given = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: F.transform(v, lambda x: x * (k * 0.1 - 0.4) + 0.05))
    out = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), given.alias("given")).select("vec_id", diffusion.solved(F.col("v"), F.col("given"), STEPS).alias("x"))
    total = lambda f: F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + f(x)), 4)
    return out.select("vec_id", (total(lambda x: x) + F.lit(0.0)).alias("total"), total(lambda x: x * x).alias("energy"))


# ---- time ----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) AS us FROM events), w AS (SELECT *, unnest([us // 2700000000 * 2700000000, us // 2700000000 * 2700000000 - 2700000000]) AS start FROM e),
    h AS (SELECT *, 1 - (1 - 1e-3) * least(1.0, abs((us - start) / 3600000000.0 - 0.5) / 0.5) AS tent FROM w WHERE us < start + 3600000000),
    m AS (SELECT event_type, start, sum(value) / count(*) AS mean FROM h GROUP BY 1, 2)
    SELECT event_id, round(sum(m.mean * tent) / sum(tent), 7) AS blended, count(*) AS windows FROM h JOIN m ON m.event_type = h.event_type AND m.start = h.start GROUP BY event_id""")
def overlap_in_time(spark, sf_dir):
    """Means of hours that begin every 45 minutes, by type, put together again at each event under a tent over each hour."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts", F.window("ts", "1 hour", "45 minutes").alias("w"))
    part = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 3_600_000_000.0
    rows = rows.select("event_id", "event_type", "value", F.col("w.start").alias("start"), (1 - (1 - 1e-3) * F.least(F.lit(1.0), F.abs(part - 0.5) / 0.5)).alias("tent"))
    means = rows.groupBy("event_type", "start").agg((F.sum("value") / F.count("*")).alias("mean"))
    both = rows.select("event_id", "event_type", "start", "tent").join(means, ["event_type", "start"])
    return both.groupBy("event_id").agg(F.round(F.sum(F.col("mean") * F.col("tent")) / F.sum("tent"), 7).alias("blended"), F.count("*").alias("windows"))


@query(ORACLE_SQL["thrash_window"])
def thrash_stream(spark, sf_dir) -> DataFrame:
    """The repeats among each user's last 32 events, by a stream with state that runs to the end of its source."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream takes a plain path for a folder
    out, state = scratch(spark, "thrash"), scratch(spark, "thrash-state")
    recent.run_to_end(recent.repeats_in_last(stream, "event_type", ["ts", "event_id"], "user_id", "event_id"), out, state)
    return spark.read.schema("event_id long, repeats int").parquet(out)


# ---- columns as runs ------------------------------------------------------------------------------


def run_columns(spark: SparkSession, sf_dir: str, kept: Column | None = None) -> DataFrame:
    """The columns as runs. Those kept are dealt out anew, as a small file of cells is one task's and runs are much work a row."""
    c = cells(spark, sf_dir)
    c = c if kept is None else c.where(kept).repartition("i", "j")
    c = c.withColumn("surface_y", F.lit(8) + (F.abs("elev_m") / 200).cast("int"))
    return c.withColumn("runs", voxel.filled_runs(F.col("surface_y"), 20, F.col("elev_m") < 0, F.col("temp_c") < -10))


@query(ORACLE_SQL["voxel_fill"])
def run_fill(spark, sf_dir):
    """Counted by runs before they are expanded, so that a run costs one row however long it is."""
    held = run_columns(spark, sf_dir).select(F.explode("runs").alias("r")).groupBy("r").agg(F.count("*").alias("m"))
    rows = held.select("r.block", "r.fluid", F.explode(F.sequence("r.low", "r.high")).alias("y"), "m")
    return rows.groupBy("block", "fluid", "y").agg(F.sum("m").alias("n"))


@query(ORACLE_SQL["glacier_cap"])
def run_glacier(spark, sf_dir):
    c = run_columns(spark, sf_dir)
    capped = voxel.glacier_runs(F.col("runs"), F.col("temp_c") < -12, F.col("surface_y"))
    return voxel.expanded(c.withColumn("runs", voxel.merged_runs(capped))).where("block = 'glacierice'").select("i", "j", "y")


@query(ORACLE_SQL["scour_to_rock"])
def run_scour(spark, sf_dir):
    # columns that aren't steep stay as they are and have no rock where soil lies
    steep, top = F.col("temp_c") > 20, F.col("surface_y")
    c = run_columns(spark, sf_dir, steep)
    soil = lambda y: (y > top - 4) & ((F.col("i") + F.col("j") + y) % 7 != 0)
    # one cut, as levels of their own need none: down to four below the surface; what lies above it is water, one level high where soil could be
    one = lambda r: F.flatten(F.transform(F.sequence(r["low"], r["high"]), lambda y: F.array(F.struct(F.when(soil(y), "soil").otherwise(r["block"]).alias("block"), r["fluid"].alias("fluid"), y.alias("low"), y.alias("high")))))
    soft = F.flatten(F.transform(voxel.split_at(F.col("runs"), top - 3), lambda r: F.when(r["high"] > top - 4, one(r)).otherwise(F.array(r))))
    c = c.withColumn("runs", soft.cast(voxel.RUNS))
    c = c.withColumn("runs", voxel.scoured_runs(F.col("runs"), steep, top))
    return voxel.expanded(c).where((F.col("block") == "rock") & soil(F.col("y"))).select("i", "j", "y")


# ---- stores, slices, plain tiles, space -----------------------------------------------------------


@query(ORACLE_SQL["voxel_fill"].rpartition("SELECT block, fluid")[0] + """, b AS (SELECT CAST(floor(i / 32.0) AS BIGINT) AS chunk_i, CAST(floor(j / 32.0) AS BIGINT) AS chunk_j, coalesce(block, fluid) AS what, y FROM f)
    SELECT chunk_i, chunk_j, what, count(*) AS voxels, CAST(sum(y) AS BIGINT) AS heights FROM b GROUP BY ALL""")
def chunk_store(spark, sf_dir):
    """The columns' runs written by chunk, one chunk of them again, and what the store then holds."""
    chunk = {f"chunk_{c}": F.floor(F.col(c) / 32.0).cast("long") for c in "ij"}
    c = run_columns(spark, sf_dir).select("i", "j", "runs").withColumns(chunk)
    path = scratch(spark, "chunks")
    for rows in (c, c.where("chunk_i = 0 and chunk_j = 1")):
        chunks.write_chunks(rows, path, list(chunk), ["i", "j"])
    held = chunks.read_chunks(spark, path).select(*[F.col(k).cast("long").alias(k) for k in chunk], F.explode("runs").alias("r"))
    size = (F.col("r.high") - F.col("r.low") + 1).cast("long")
    parts = held.groupBy(*chunk, F.coalesce("r.block", "r.fluid").alias("what"))
    return parts.agg(F.sum(size).alias("voxels"), F.sum(F.expr("(cast(r.low as long) + r.high) * (r.high - r.low + 1) div 2")).alias("heights"))


@query(ORACLE_SQL["tile_assembly"].partition("SELECT c.i, c.j")[0] + f"""SELECT c.i, c.j, round(c.elev_m, 4) AS elevation_m, {block_y_of(HEIGHTS, "c.elev_m")} AS surface_y, round(s.slope, 4) AS slope
    FROM cells c JOIN slopes s ON s.i = c.i AND s.j = c.j""")
def tile_assembly_plain(spark, sf_dir):
    """Tiles of a world without climate."""
    c = cells(spark, sf_dir)
    return rounded(assemble(c, raster.sobel_slope(c, "elev_m", 15.0), HEIGHTS))


@query(f"""WITH {CELLS}, w AS (SELECT *, CASE WHEN (i + j) % 6 = 0 THEN 0.0 ELSE 0.25 * (1 + (i * j) % 4) END AS w FROM cells WHERE i BETWEEN 3 AND 21 AND j BETWEEN 5 AND 40)
    SELECT i - 3 AS i, j - 5 AS j, {', '.join(f'round(CASE WHEN w > 1e-6 THEN (elev_m + {k} * temp_c) * w / w ELSE 0.0 END, 4) + 0.0 AS c{k}' for k in range(6))}, w FROM w""")
def coarse_slice(spark, sf_dir):
    """Six weighted channels and their weight, cut to a range and brought back by the weight."""
    w = F.when((F.col("i") + F.col("j")) % 6 == 0, 0.0).otherwise(0.25 * (1 + (F.col("i") * F.col("j")) % 4))
    held = cells(spark, sf_dir).withColumn("w", w).withColumns({f"c{k}": (F.col("elev_m") + k * F.col("temp_c")) * F.col("w") for k in range(6)})
    cut = grid.sliced(held, 3, 22, 5, 41)
    return cut.select("i", "j", *[(F.round(composers.normalised(F.col(f"c{k}"), F.col("w")), 4) + F.lit(0.0)).alias(f"c{k}") for k in range(6)], "w")


EDGE = "[" + ", ".join(f"[{a:.0f}, {b:.0f}, {c:.0f}]" for a, b, c in fields._EDGES) + "]"


@query(f"""WITH {CELLS}, p AS (SELECT i, j, i / 9.0 AS x, j / 9.0 AS y, elev_m / 700 AS z FROM cells), c AS (SELECT unnest(range(2)) AS v),
    k AS (SELECT p.*, a.v AS a, b.v AS b, c.v AS c, x - floor(x) AS u, y - floor(y) AS v, z - floor(z) AS w FROM p, c a, c b, c c),
    h AS (SELECT *, (xor(xor(xor(31, ((CAST(floor(x) AS BIGINT) + a) * {noise.PRIMES[0]}) & 4294967295), ((CAST(floor(y) AS BIGINT) + b) * {noise.PRIMES[1]}) & 4294967295), ((CAST(floor(z) AS BIGINT) + c) * {noise.PRIMES[2]}) & 4294967295) * {noise.HASH_FACTOR}) & 4294967295 AS h FROM k),
    g AS (SELECT *, ({EDGE})[((xor(h, h >> 15) >> 2) & 63) + 1] AS g FROM h),
    t AS (SELECT *, (CASE a WHEN 1 THEN u * u * u * (u * (u * 6 - 15) + 10) ELSE 1 - u * u * u * (u * (u * 6 - 15) + 10) END) * (CASE b WHEN 1 THEN v * v * v * (v * (v * 6 - 15) + 10) ELSE 1 - v * v * v * (v * (v * 6 - 15) + 10) END)
      * (CASE c WHEN 1 THEN w * w * w * (w * (w * 6 - 15) + 10) ELSE 1 - w * w * w * (w * (w * 6 - 15) + 10) END) AS share FROM g)
    SELECT i, j, round(sum(share * (g[1] * (u - a) + g[2] * (v - b) + g[3] * (w - c))) * {fields.PERLIN3_SCALE!r}, 6) + 0.0 AS noise FROM t GROUP BY i, j""")
def noise_in_space(spark, sf_dir):
    """Gradient noise in three dimensions over the lattice and its heights."""
    @F.pandas_udf("double")
    def at(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(fields.perlin3(31, x.to_numpy(float), y.to_numpy(float), z.to_numpy(float)))

    c = cells(spark, sf_dir)
    return c.select("i", "j", (F.round(at(F.col("i") / 9.0, F.col("j") / 9.0, F.col("elev_m") / 700), 6) + F.lit(0.0)).alias("noise"))
