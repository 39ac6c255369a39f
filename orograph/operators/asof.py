"""As-of joins with tables of any length: the rows of a table just before and just after each value.

Values and table rows are laid out together by key, in ranges that a sketch of the keys cuts evenly.
Within a range the last table row is carried forward and the next one back; what a range begins and
ends with comes from the neighbours, of which each sends one row. No array holds a table, none is
broadcast, and no task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about, and ranges at most; a range that is larger is sorted on disk.
RANGE, MOST_RANGES = 1 << 20, 8192
#: Of the sketch that cuts the ranges.
ACCURACY = 10_000


def _cuts(rows: DataFrame, key: str, ranges: int) -> Column | None:
    """The places between ranges as one array: from a sketch, the same however often it is worked out."""
    if ranges < 2:
        return None
    cuts = rows.agg(F.percentile_approx(key, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), ACCURACY)).first()[0]
    return F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else None


def bracketed(values: DataFrame, table: DataFrame, at: str, key: str, by: list[str], carry: list[str], ranges: int | None = None) -> DataFrame:
    """The different (by, at) of values with before and after: structs (key, carry) of the table rows around them.

    before is the last table row (by, key, carry) with key <= at, of equal keys the one with the
    greatest carry; after is the first with key > at, of equal keys the one with the least carry.
    Either is null where there is none. Null keys and values match nothing. ranges: into how many
    the keys are cut, as their number asks for if not given.
    """
    row = F.struct(F.col(key).cast("double").alias("key"), *carry)
    places = table.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("double").alias("_at"), F.lit(0).alias("_tag"), row.alias("_row"))
    asked = values.where(F.col(at).isNotNull()).select(*by, F.col(at).cast("double").alias("_at")).distinct()
    asked = asked.select("*", F.lit(1).alias("_tag"), F.lit(None).cast(dict(places.dtypes)["_row"]).alias("_row"))
    both = places.unionByName(asked)
    if ranges is None:
        # of all rows, which costs less to know than the number of different values
        ranges = min(MOST_RANGES, -(-(values.count() + table.count()) // RANGE))
    cuts = _cuts(both, "_at", ranges)
    both = both.withColumn("_range", F.lit(0) if cuts is None else F.size(F.filter(cuts, lambda c: c <= F.col("_at"))))
    # both frames begin with the partition, as one that ends with it would be read anew for each row
    up = Window.partitionBy(*by, "_range").orderBy("_at", "_tag", "_row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "_range").orderBy(F.desc("_at"), F.desc("_tag"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    held = both.select("*", F.last("_row", True).over(up).alias("before")).select("*", F.last("_row", True).over(down).alias("after"))
    held = held.where("_tag = 1").drop("_tag", "_row")
    if cuts is not None:
        # one row for each range: the table's last and first rows of the ranges before and after it
        ends = both.groupBy(*by, "_range").agg(F.max("_row").alias("_last"), F.min("_row").alias("_first"))
        order = Window.partitionBy(*(by or [F.lit(0)]))
        earlier = F.last("_last", True).over(order.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        later = F.last("_first", True).over(order.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.select(*by, "_range", earlier.alias("_earlier"), later.alias("_later"))
        held = held.join(carried, [*by, "_range"]).select(*by, "_at", F.coalesce("before", "_earlier").alias("before"), F.coalesce("after", "_later").alias("after"))
    return held.select(*by, F.col("_at").alias(at), "before", "after")


def asof(values: DataFrame, table: DataFrame, at: str, key: str, by: list[str], carry: list[str], ranges: int | None = None) -> DataFrame:
    """values with before and after (see bracketed()); each different value is looked up once, however many rows have it."""
    found = bracketed(values, table, at, key, by, carry, ranges)
    return values.withColumn("_at", F.col(at).cast("double")).join(found.withColumnRenamed(at, "_at"), [*by, "_at"], "left").drop("_at")


def interpolated(values: DataFrame, table: DataFrame, at: str, x: str = "x", y: str = "y", by: list[str] | None = None, name: str = "mapped", ranges: int | None = None) -> DataFrame:
    """values with the piecewise linear lookup of at in the table (by, x, y); the end values beyond its ends, null without a table."""
    by = by or []
    found = asof(values, table, at, x, by, [y], ranges)
    a, b, v = F.col("before"), F.col("after"), F.col(at).cast("double")
    line = (v - a["key"]) / (b["key"] - a["key"]) * (b[y] - a[y]) + a[y]
    mapped = F.when(a.isNull(), b[y]).when(b.isNull(), a[y]).otherwise(line)
    return found.withColumn(name, mapped).drop("before", "after")
