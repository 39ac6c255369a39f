"""Surveys and searches over cells: tail quantiles, bands, nested boxes, calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Starting climates with their temperatures; they leave gaps.
BANDS = (("hot", 28.0, 32.0), ("warm", 19.0, 23.0), ("temperate", 6.0, 14.0), ("cool", -5.0, 1.0), ("icy", -15.0, -10.0))


def bands(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(a).alias("min_c"), F.lit(b).alias("max_c")) for c, a, b in BANDS])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def parsed_code(code: Column) -> Column:
    """The code of a band, whatever its case and the white space around it; null for anything else."""
    plain = F.lower(F.trim(F.regexp_replace(code, r"^\s+|\s+$", "")))
    return F.when(plain.isin([c for c, _, _ in BANDS]), plain)


def in_band(temp: Column, low: Column | float, high: Column | float) -> Column:
    return temp.between(low, high)


def band_miss(temp: Column, low, high) -> Column:
    """How far outside the band; 0 within."""
    return F.greatest(low - temp, temp - high, F.lit(0.0))


def with_band(sites: DataFrame, temp: str) -> DataFrame:
    """Every row with the code of its band, null in the gaps: a broadcast join with the five bands."""
    b = F.broadcast(bands(sites.sparkSession))
    return sites.join(b, F.col(temp).between(F.col("min_c"), F.col("max_c")), "left").drop("min_c", "max_c")


#: Rows of a bin, about, and bins at least.
BIN, LEAST_BINS = 1 << 20, 16


def halved(most: int, true: Callable[[Column], Column]) -> Column:
    """For how many of the places from 0 on, of which there are no more than most, true holds, if for none after the first where it doesn't or is null: by halves."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(true(n + step - 1), n + step).otherwise(n))


def at_or_below(edges: Column, x: Column, most: int) -> Column:
    """How many of the edges, ascending and no more than most, are at or below x, so that many cost little more than few."""
    return halved(most, lambda k: F.get(edges, k) <= x)


def binned(rows: DataFrame, value: str, bins: int | None = None, edge: Column | None = None) -> DataFrame:
    """rows with bin: how many of about so many even quantiles lie at or below value; null values go.

    The edges come from a sketch (of edge, or else of value), so that bins hold about as many rows whatever
    the values. bins: as many as the rows ask for, if not given.
    """
    bins = bins or max(LEAST_BINS, -(-rows.count() // BIN))
    rows = rows.where(F.col(value).isNotNull())
    if bins < 2:
        return rows.withColumn("bin", F.lit(0))
    edges = rows.agg(F.percentile_approx(F.col(value) if edge is None else edge, F.array(*[F.lit((k + 1) / bins) for k in range(bins - 1)]), 10_000).alias("_edges"))
    out = rows.crossJoin(F.broadcast(edges))
    return out.withColumn("bin", at_or_below(F.col("_edges"), F.col(value), bins - 1)).drop("_edges")


def counted(rows: DataFrame, value: str, by: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """(by, v, n, before, total): each value of a group with its rows, the rows below it, and all; values are ranked within bins, whose few totals alone meet."""
    by = by or []
    bins = bins or max(LEAST_BINS, -(-rows.count() // BIN))  # of all rows, which costs less to know than the number of different values
    counts = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    # the edges read n as well, so that Spark sees one exchange in all that read the counts and makes it once
    counts = binned(counts, "v", bins, F.when(F.col("n") > 0, F.col("v")))
    starts = counts.groupBy(*by, "bin").agg(F.sum("n").alias("m"))
    of = Window.partitionBy(*(by or [F.lit(0)]))
    starts = starts.select(*by, "bin", (F.sum("m").over(of.orderBy("bin")) - F.col("m")).alias("start"), F.sum("m").over(of).alias("total"))
    inner = Window.partitionBy(*by, "bin").orderBy("v")
    return counts.join(F.broadcast(starts) if not by else starts, [*by, "bin"]).select(*by, "v", "n", (F.col("start") + F.sum("n").over(inner) - F.col("n")).alias("before"), "total")


def quantile_rows(rows: DataFrame, value: str, by: list[str], fractions: list[float], bins: int | None = None) -> DataFrame:
    """(by, place, value): the exact quantiles of each group, interpolated between neighbours, as rows numbered from 0."""
    c = counted(rows, value, by, bins)
    order = sorted(range(len(fractions)), key=lambda k: fractions[k])
    sorted_fractions, places = F.array(*[F.lit(float(fractions[k])) for k in order]), F.array(*[F.lit(k) for k in order])
    spot = lambda k: (F.col("total") - 1).cast("double") * F.get(sorted_fractions, k)
    # a value holds the ranks from before to before + n: by halves, which of the fractions lie on them or just above or below,
    # so that a row costs little however many fractions there are, and few rows go on
    first = halved(len(fractions), lambda k: F.ceil(spot(k)) < F.col("before"))
    end = halved(len(fractions), lambda k: F.floor(spot(k)) < F.col("before") + F.col("n"))
    held = c.where(first < end).select(*by, "v", "before", "total", F.explode(F.sequence(first, end - 1)).alias("k"))
    at = spot(F.col("k"))
    ends = held.groupBy(*by, "k").agg(F.max(F.when(F.col("before") <= F.floor(at), F.col("v"))).alias("a"), F.max("v").alias("b"), F.max(at - F.floor(at)).alias("part"))
    return ends.select(*by, F.get(places, F.col("k")).alias("place"), (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).cast("double").alias(value)).where(F.col(value).isNotNull())


def tail_order_statistic(cells: DataFrame, value: str, quantile: float) -> DataFrame:
    """One row: the value at place int((1 - quantile) * n) from the top, without interpolation; none if there are no rows."""
    c = counted(cells, value)
    from_top = F.least(F.floor(F.col("total") * (1 - quantile)), F.col("total") - 1)
    place = F.col("total") - 1 - from_top
    return c.where((F.col("before") <= place) & (F.col("before") + F.col("n") > place)).select(F.col("v").alias(value))


def quantiles(rows: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """One row (quantiles): an array of exact quantiles, interpolated between neighbours; nulls if there are no rows.

    Each fraction's two places are looked up among the counted values; only these meet in one task.
    """
    c = counted(rows, value)
    spot = F.col("total").cast("double")
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), ((spot - 1) * f).alias("at")) for k, f in enumerate(fractions)])
    held = c.select("v", "n", "before", F.explode(wanted).alias("w")).select("v", "n", "before", "w.k", "w.at")
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda place: (F.col("before") <= place) & (F.col("before") + F.col("n") > place)
    ends = held.where(holds(low) | holds(high)).groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.first(F.col("at") - low).alias("part"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    table = ends.agg(F.map_from_entries(F.collect_list(F.struct("k", value_at.cast("double")))).alias("m"))
    return table.select(F.array(*[F.try_element_at(F.col("m"), F.lit(k)) for k in range(len(fractions))]).alias("quantiles"))


def box_series(first: int, most: int) -> list[int]:
    out = [first]
    while out[-1] < most:
        out.append(min(most, out[-1] * 2))
    return out


def nested_boxes(cells: DataFrame, dr: str, dc: str, first: int = 16, most: int = 128, ns_cost: float = 2.0) -> DataFrame:
    """Cells with the smallest searched box that holds them, and their cost; those in no box go.

    A box of size b holds -b/2 + 1 <= d <= b/2 - 2, as its rim is eroded. Boxes are nested, so
    one pass does for a search that doubles.
    """
    box = None
    for b in box_series(first, most):
        inside = F.col(dr).between(-(b // 2) + 1, b // 2 - 2) & F.col(dc).between(-(b // 2) + 1, b // 2 - 2)
        box = F.when(inside, b) if box is None else box.when(inside, b)
    cost = F.pow(F.col(dr) * ns_cost, 2.0) + F.col(dc) * F.col(dc)
    return cells.withColumn("box", box).withColumn("cost", cost).where("box is not null")


def best(cells: DataFrame, keys: list[str], top: int = 1) -> DataFrame:
    """The first rows by keys; a bounded top-k, merged from each task's own."""
    return cells.orderBy(*keys).limit(top)


def find_spawn(cells: DataFrame, low: float, high: float, temp: str = "temp_c", dr: str = "dr", dc: str = "dc", **boxes) -> DataFrame:
    """At most one row: the cheapest land cell in the band from the smallest box that has one, else the nearest miss."""
    found = nested_boxes(cells, dr, dc, **boxes).withColumn("miss", band_miss(F.col(temp), low, high))
    found = found.withColumn("matched", F.col("miss") == 0)
    rank = F.when(F.col("matched"), F.struct(F.lit(0).alias("a"), F.col("box").cast("double").alias("b"), F.col("cost").alias("c")))
    rank = rank.otherwise(F.struct(F.lit(1).alias("a"), F.col("miss").alias("b"), F.col("cost").alias("c")))
    return best(found.withColumn("rank", rank), ["rank", "box", dr, dc]).drop("rank")


def probes(cells: DataFrame, value: str, tie: list[str], count: int, pool: float = 0.25) -> DataFrame:
    """count rows strided over the highest share of the cells, highest first; ranked within bins of value."""
    n = cells.agg(F.greatest(F.lit(1), (F.count("*") * pool).cast("long")).alias("pool"))
    held = binned(cells, value)
    starts = held.groupBy("bin").agg(F.count("*").alias("m"))
    starts = starts.select("bin", (F.sum("m").over(Window.orderBy(F.desc("bin"))) - F.col("m")).alias("start"))
    inner = Window.partitionBy("bin").orderBy(F.desc(value), *tie)
    ranked = held.join(F.broadcast(starts), "bin").withColumn("rank", F.col("start") + F.row_number().over(inner) - 1)
    places = cells.sparkSession.range(count).withColumnRenamed("id", "probe").crossJoin(F.broadcast(n))
    places = places.select("probe", F.floor(F.col("probe") * F.col("pool") / float(count)).alias("rank"))
    return ranked.join(F.broadcast(places), "rank").select("probe", *cells.columns)


def repeats_in_last(rows: DataFrame, key: str, order: list[str], last: int = 32, partition: str | None = None) -> DataFrame:
    """How often each row's key was among the last rows of its partition, itself included: a thrash detector."""
    w = Window.partitionBy(*([partition] if partition else [])).orderBy(*order).rowsBetween(-(last - 1), 0)
    seen = F.collect_list(key).over(w)
    return rows.withColumn("repeats", F.size(F.filter(seen, lambda x: x == F.col(key))))
