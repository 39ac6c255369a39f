"""Queries that fit and apply in one plan: tables joined as of a value, maps from noise, heights from a survey, time windows, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions import mapping
from orograph.operators import asof, noise, stages, survey
from orograph.plans.noise_sql import noise_sql
from orograph.plans.shared import CELLS, SITES, query, rounded
from orograph.plans.worlds import HEIGHTS, block_y_of, calibration_sql, pixels
from orograph.sources.tables import cells, sites, table

# ---- as-of joins ----------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_linenumber % 3 AS c, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v FROM lineitem),
    t AS (SELECT CAST(c_custkey % 3 AS INT) AS c, c_acctbal * 10 AS x, max(c_custkey) * 0.5 AS top, min(c_custkey) * 0.5 AS low FROM customer WHERE c_custkey % 7 > 0 GROUP BY 1, 2),
    a AS (SELECT p.*, t.x AS x0, t.top AS y0 FROM p ASOF LEFT JOIN t ON p.c = t.c AND p.v >= t.x), b AS (SELECT a.*, t.x AS x1, t.low AS y1 FROM a ASOF LEFT JOIN t ON a.c = t.c AND a.v < t.x)
    SELECT l_orderkey, l_linenumber, l_partkey, v, round(x0, 4) AS x0, round(x1, 4) AS x1, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE (v - x0) / (x1 - x0) * (y1 - y0) + y0 END, 4) AS mapped FROM b""")
def quantile_asof(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("c"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("v"))
    tables = table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select((F.col("c_custkey") % 3).cast("int").alias("c"), (F.col("c_acctbal") * 10).alias("x"), (F.col("c_custkey") * 0.5).alias("y"))
    found = asof.asof(values, tables, "v", "x", ["c"], ["y"])
    a, b, v = F.col("before"), F.col("after"), F.col("v")
    mapped = F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise((v - a["key"]) / (b["key"] - a["key"]) * (b["y"] - a["y"]) + a["y"])
    return rounded(found.select("l_orderkey", "l_linenumber", "l_partkey", "v", a["key"].alias("x0"), b["key"].alias("x1"), mapped.alias("mapped")))


# ---- a map from its own noise ----------------------------------------------------------------

WORLD, STRIDE, FREQUENCIES = 977, 32, [1.1, 0.7, 1.3, 0.9, 1.7]
EPS, PLACES = 1e-4, 64
QUANTILES = [EPS + k * (1 - 2 * EPS) / (PLACES - 1) for k in range(PLACES)]
DATA = {"elev": "elev_m", "temp": "bio1", "temp_std": "bio4", "precip": "bio12", "precip_std": "bio15"}


def bank_sql(stride: int) -> str:
    """A subquery (i, j, channels): the noise bank at every stride-th place, to nine digits."""
    parts = [noise_sql("gradient", WORLD + k + 1, noise.BANK_FREQUENCY * m * stride, octaves) for k, (octaves, m) in enumerate(zip(noise.BANK.values(), FREQUENCIES, strict=True))]
    joins = " ".join(f"JOIN {q} AS t{k} USING (i, j)" for k, q in enumerate(parts))
    return f"(SELECT i, j, {', '.join(f'round(t{k}.noise, 9) AS {c}' for k, c in enumerate(noise.BANK))} FROM cells {joins})"


def _stack_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS channel, CAST({c} AS DOUBLE) AS v FROM {source}" for c in DATA)


FITTED_SQL = f"""{CELLS}, {SITES}, data AS (SELECT {', '.join(f'{v} AS {k}' for k, v in DATA.items())} FROM sites), strided AS MATERIALIZED {bank_sql(STRIDE)}, bank AS MATERIALIZED {bank_sql(1)},
    q AS (SELECT channel, quantile_cont(v, {QUANTILES!r}) AS t FROM ({_stack_sql("strided")}) GROUP BY channel), v AS MATERIALIZED (SELECT channel, unnest(range({PLACES})) AS k, unnest(t) AS x FROM q),
    l AS (SELECT channel, coalesce(min(d) FILTER (d > 0), 1e-10) * 0.1 AS least FROM (SELECT channel, x - lag(x) OVER (PARTITION BY channel ORDER BY k) AS d FROM v) GROUP BY channel),
    r AS (SELECT channel, 0 AS k, x AS y FROM v WHERE k = 0 UNION ALL SELECT r.channel, r.k + 1, CASE WHEN v.x <= r.y THEN r.y + least ELSE v.x END FROM r JOIN v ON v.channel = r.channel AND v.k = r.k + 1 JOIN l ON l.channel = r.channel),
    w AS (SELECT channel, unnest(range({PLACES})) AS k, unnest(t) AS y FROM (SELECT channel, quantile_cont(v, {QUANTILES!r}) AS t FROM ({_stack_sql("data")}) GROUP BY channel)),
    tables AS MATERIALIZED (SELECT r.channel, r.k, r.y AS x, w.y FROM r JOIN w ON w.channel = r.channel AND w.k = r.k)"""


@query(f"""WITH RECURSIVE {FITTED_SQL}, s AS (SELECT i, j, unnest([{', '.join(f"'{c}'" for c in DATA)}]) AS channel, unnest([{', '.join(DATA)}]) AS v FROM bank),
    a AS (SELECT s.*, t.x AS x0, t.y AS y0 FROM s ASOF LEFT JOIN tables t ON s.channel = t.channel AND s.v >= t.x), b AS (SELECT a.*, t.x AS x1, t.y AS y1 FROM a ASOF LEFT JOIN tables t ON a.channel = t.channel AND a.v < t.x),
    m AS (SELECT i, j, channel, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE (v - x0) / (x1 - x0) * (y1 - y0) + y0 END AS mapped FROM b),
    p AS (SELECT i, j, {', '.join(f"max(mapped) FILTER (channel = '{c}') AS {c}" for c in DATA)} FROM m GROUP BY i, j),
    u AS (SELECT *, greatest(-10.0, least(40.0, temp + greatest(-9.8, least(-4.0, -6.5 + 0.0015 * precip)) / 1000 * greatest(0.0, elev))) AS warm FROM p), z AS (SELECT *, -8.5 * warm + 300.0 AS base, greatest(50.0, -(-8.5 * warm + 300.0)) AS low FROM u)
    SELECT i, j, round(sign(elev) * sqrt(abs(elev)), 4) AS elev, round(warm, 4) AS temp, round(greatest(20.0, (temp_std - 50.0) / 850.0 * (900.0 - low) + low + base), 4) AS temp_std, round(precip, 4) AS precip,
    round(precip_std * greatest(0.0, (185 - 0.04111 * precip) / 185), 4) AS precip_std FROM z""")
def synthetic_from_noise(spark, sf_dir):
    """Noise over the lattice, brought to the distributions of the sites by tables fitted on the strided lattice."""
    # dealt out first, as a small file of cells is one task's and noise is much work a row
    c = cells(spark, sf_dir).select("i", "j").repartition("i", "j")
    strided, bank = ([F.round(x, 9).alias(k) for k, x in noise.bank_columns(WORLD, FREQUENCIES, stride).items()] for stride in (STRIDE, 1))
    data = sites(spark, sf_dir).select(*[F.col(v).alias(k) for k, v in DATA.items()])
    tables = stages.fitted_tables(c.select(*strided), data, list(DATA), QUANTILES)
    channels = stages.distributed_as(c.distinct().select("i", "j", *bank), tables, list(DATA), PLACES)
    return rounded(stages.synthetic_map(channels, -8.5, 300.0, 50.0, 900.0).select("i", "j", *DATA))


# ---- heights from a survey in the same plan ----------------------------------------------------

_MEASURED = calibration_sql(8).rpartition("SELECT half, land_cells, round(survey_m")[0]
_BPM = f"(greatest(1.0, least(20.0, 0.92 * {HEIGHTS.headroom} * 15 / peak_m)) / 15)"
_LINEAR = "CASE WHEN l <= knee THEN l ELSE (l - knee) / greatest(1.0, head - knee) / ((l - knee) / greatest(1.0, head - knee) + 1) * greatest(1.0, head - knee) + knee END"


@query(f"""{_MEASURED}, g AS (SELECT {_BPM} AS bpm, CAST({HEIGHTS.headroom} AS DOUBLE) AS head FROM f), h AS (SELECT *, CASE WHEN {mapping.MAX_ELEVATION_M!r} * bpm <= head THEN head ELSE head * {HEIGHTS.knee_fraction!r} END AS knee FROM g),
    e AS (SELECT i, j, elev_m, elev_m * bpm AS l, knee, head, bpm FROM cells, h)
    SELECT i, j, round(bpm, 6) AS blocks_per_metre, CASE WHEN elev_m >= 0 THEN CAST(trunc({_LINEAR}) AS INT) + {HEIGHTS.sea_level} ELSE {block_y_of(HEIGHTS, "elev_m")} END AS surface_y, l > head AS too_high FROM e""")
def calibrated_heights(spark, sf_dir):
    """Every cell's surface under the gain that the survey of the same cells asks for: one plan, no number goes through the driver."""
    c = cells(spark, sf_dir)
    middle = c.agg(F.floor((F.max("i") + 1) / 2).cast("long").alias("middle"))
    placed = c.crossJoin(F.broadcast(middle))
    found = survey.fitted(survey.calibration(placed, pixels(spark, sf_dir), (F.col("middle"), F.lit(25)), 2, quantile=0.95, probes=8), HEIGHTS.headroom)
    gain = F.col("blocks_per_metre")
    held = c.crossJoin(F.broadcast(found.select("blocks_per_metre")))
    return held.select("i", "j", F.round(gain, 6).alias("blocks_per_metre"), HEIGHTS.block_y(F.col("elev_m"), gain).alias("surface_y"), (F.col("elev_m") * gain > HEIGHTS.headroom).alias("too_high"))
