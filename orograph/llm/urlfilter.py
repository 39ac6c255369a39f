"""URL rules as a sort-merge range join.

A rule is a host and a path prefix; it fits its host and all subdomains. Keys are the host with
its labels reversed, a mark, and the path, so that a rule is the interval of all keys that begin
with its own key. A url has one key for each suffix of its host. Keys and rules are cut into
ranges at boundaries from a sample; each range is sorted and swept once with a stack of the
rules that are open at that point, the innermost on top. A rule goes to every range that its
interval touches: to those that it begins in, and to those whose first key it is a prefix of.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm.common import cut

#: After the host; before every character of a path.
MARK = "\x01"
#: Keys that the boundaries of the ranges are taken from.
SAMPLE_KEYS = 20_000


def host_of(url) -> F.Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> F.Column:
    """After the host up to ?, # or the end; empty if there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host) -> F.Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a frame."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, kind, rule) sorted by part, key, kind; rules (kind 0) come before urls.

    Gives (key, rule) for each url key with an open rule, the innermost.
    """
    part, stack = None, []
    for batch in batches:
        keys, found = [], []
        for p, key, kind, rule in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule))
            elif stack:
                keys.append(key)
                found.append(stack[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "rule_key"])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages.

    The longest rule whose host is the url's or a parent of it and whose path begins the url's
    path wins; of rules with the same host and path, a blocking one. rule is its host and path
    joined; null where none fits, and verdict is then ``default``. A rule with an empty path fits
    every path, one with ``/`` those that aren't empty. A
    null url, or one without ``://``, has an empty host and path and fits no rule. Equal keys are
    judged once, so copies of a url cost one row each. Rules with a null or empty host are
    ignored. Columns beside the two named are ignored.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule_path = F.coalesce("path", F.lit(""))
    rule_key = F.concat(reversed_host(F.lower("host")), F.lit(MARK), rule_path)
    named = rules.where("host is not null and host <> ''").select(rule_key.alias("rule_key"), F.concat(F.lower("host"), rule_path).alias("rule"), "verdict")
    # min is the blocking verdict's: what isn't allow blocks
    named = cut(named.groupBy("rule_key").agg(F.min("rule").alias("rule"), F.max(F.col("verdict") != "allow").alias("blocks")).select("rule_key", "rule", F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict")))

    labels = F.split(F.col("host"), r"\.", -1)
    depth = F.sequence(F.lit(1), F.size(labels))
    suffixes = F.transform(depth, lambda n: F.concat(F.array_join(F.slice(F.reverse(labels), 1, n), "."), F.lit(MARK), F.col("path")))
    places = rows.where("host <> ''").select("host", "path").distinct()
    keys = places.select(F.explode(suffixes).alias("key")).distinct()

    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = cut(keys)
    n = keys.count()
    every = max(1, n // SAMPLE_KEYS)
    some = [r[0] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).limit(4 * SAMPLE_KEYS).collect()]
    some.sort(key=str.encode)
    cuts = sorted({some[len(some) * i // ranges] for i in range(1, ranges)} if some else set(), key=str.encode)
    bounds = spark.sparkContext.broadcast([c.encode() for c in cuts])

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(bounds.value, k) for k in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0)], ["part", "key"])

    def touched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # beside its own range, a rule goes to those ranges whose first key it is a prefix of
        for batch in batches:
            parts, keys = [], []
            for k in batch.column(0).cast(pa.binary()).to_pylist():
                own = bisect_right(bounds.value, k)
                end = bisect_right(bounds.value, k + b"\xff")
                parts += range(own, end + 1)
                keys += [k.decode()] * (end + 1 - own)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.string())], ["part", "key"])

    urls = keys.mapInArrow(placed, "part int, key string").selectExpr("part", "key", "1 as kind", "cast(null as string) as rule")
    opened = named.select("rule_key").mapInArrow(touched, "part int, key string").selectExpr("part", "key", "0 as kind", "key as rule")
    swept = urls.union(opened).repartition(F.col("part")).sortWithinPartitions("part", "key", "kind")
    hits = swept.mapInArrow(_sweep, "key string, rule_key string")
    hits = cut(hits.join(named, "rule_key").select("key", "rule", "verdict"))

    best = places.select("host", "path", F.explode(suffixes).alias("key")).join(hits, "key")
    best = best.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    judged = rows.join(cut(best.select("host", "path", "best.rule", "best.verdict")), ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
