"""What the query modules share: the registry, and SQL of the views that queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES, ORACLE_SQL = {}, {}

SITES = """sites AS (SELECT l_orderkey, l_linenumber, l_quantity - 15 AS bio1, l_discount * 10000 AS bio4, l_extendedprice / 25 AS bio12,
    l_tax * 1500 AS bio15, (l_extendedprice - 20000) / 15 AS elev_m, l_discount * 15 AS slope, epoch_us(l_shipdate) / 86400000000.0 AS days FROM lineitem)"""
BIO = SITES + """, b0 AS (SELECT *, greatest(0.0, bio4) / 100 AS sigma FROM sites),
b1 AS (SELECT *, greatest(0.0, bio1 + 0.5 * sigma) AS e, sigma * 1.414 AS amp, bio1 - 1.4142136 * sigma AS coldest, bio1 + 1.4142136 * sigma AS warmest FROM b0),
b2 AS (SELECT *, greatest(250.0, 250 + 25 * e + 0.7 * e * e) AS pet,
    CASE WHEN amp < 0.1 THEN CASE WHEN bio1 > 5 THEN 365.0 ELSE 0.0 END WHEN (5 - bio1) / amp <= -1 THEN 365.0 WHEN (5 - bio1) / amp >= 1 THEN 0.0
    ELSE 365 * (0.5 - asin(greatest(-1.0, least(1.0, (5 - bio1) / amp))) / pi()) END AS gsd FROM b1),
b3 AS (SELECT *, bio12 / greatest(1.0, pet) AS ai FROM b2),
b4 AS (SELECT *, ai * (1 - 0.35 * least(1.0, bio15 / 100)) AS tm FROM b3),
bio AS (SELECT *, tm * greatest(0.0, least(1.0, (gsd - 60) / 90)) AS etm, 0.7 + 0.49 * greatest(0.0, least(1.0, (tm - 0.35) / 0.45)) AS bare FROM b4)"""
FOREST_SQL = "CASE WHEN etm < 0.2 THEN 0.0 WHEN etm < 0.5 THEN 0.05 + 0.25 * (etm - 0.2) / 0.3 WHEN etm < 0.8 THEN 0.30 + 0.28 * (etm - 0.5) / 0.3 WHEN etm < 1.3 THEN 0.58 + 0.24 * (etm - 0.8) / 0.5 ELSE least(1.0, 0.82 + 0.18 * (etm - 1.3) / 0.7) END"
SHRUB_SQL = "CASE WHEN etm < 0.08 THEN 0.0 WHEN etm < 0.45 THEN 0.05 + 0.60 * (etm - 0.08) / 0.37 WHEN etm < 1.0 THEN 0.65 - 0.40 * (etm - 0.45) / 0.55 ELSE 0.25 END"
COVER_SQL = "CASE WHEN etm < 0.2 THEN 'none' WHEN etm < 0.5 THEN 'sparse' WHEN etm < 0.8 THEN 'forest' WHEN etm < 1.3 THEN 'dense' ELSE 'rainforest' END"
CELLS = """cells AS (SELECT CAST(floor(p_partkey / 50.0) AS BIGINT) AS i, CAST(p_partkey % 50 AS BIGINT) AS j,
    (p_retailprice - 920) * 50 + (p_size - 25) * 20 AS elev_m, CAST(p_size - 15 AS DOUBLE) AS temp_c FROM part)"""
ROWS = "(SELECT max(i) + 1 FROM cells)"
KEYS = ["l_orderkey", "l_linenumber"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """The same rows with doubles rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def grid_rows(df: DataFrame) -> int:
    """Rows of the lattice: one number."""
    return df.agg(F.max("i")).first()[0] + 1
