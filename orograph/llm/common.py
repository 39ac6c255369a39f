"""Shared helpers: the shared folder, cutting lineage, whole-text word blocks, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text that are turned into Python words at a time.
BLOCK_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_STR_SPACE = re.compile(r"\s")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new local one, on one machine (local mode) only."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, held in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def learning_rows(doc_id) -> F.Column:
    """True for rows that models may learn from: crc32 of the id as text, mod 4, isn't 2."""
    return ~F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def within_share(h, share: float) -> F.Column:
    """True for about that share of the values of a 64-bit hash; for all at 1."""
    return h <= F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def spans(values: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of each run of equal values."""
    if not len(values):
        return []
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(starts, [*starts[1:], len(values)], strict=True))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of the text or binary column each."""
    size = np.asarray(pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0))
    for a, b in spans(np.cumsum(size, dtype=np.int64) // most):
        yield batch.slice(a, b - a)


def word_blocks(text: bytes | None, carry: int = 0, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lists of the words of a whole text, each list beginning with the last carry words before it.

    Words are runs without ASCII white space. A text of any length is taken in blocks that end
    at white space, so that no more than a block's words exist at a time.
    """
    if not text:
        return
    if len(text) <= size:
        if words := text.split():
            yield words
        return
    at, tail, more = 0, [], False
    while at < len(text):
        found = _SPACE.search(text, min(at + size, len(text)))
        end = found.start() if found else len(text)
        words = text[at:end].split()
        at = end + 1
        tail += words
        more |= bool(words)
        # too few words wait for the next block, so that those carried never come alone
        if more and (len(tail) > carry or at >= len(text)):
            yield tail
            tail, more = tail[-carry:] if carry else [], False


def text_blocks(text: str | None, size: int = BLOCK_BYTES) -> Iterator[str]:
    """A whole text in parts of about so many characters, each ending at white space or the end."""
    at = 0
    while text and at < len(text):
        end = at + size
        if end < len(text) and (found := _STR_SPACE.search(text, end)):
            end = found.end()
        elif end < len(text):
            end = len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star steps until they change nothing. Nothing but two
    totals reaches the driver. Nulls and loops are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(pairs.where("u <> v").distinct())

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
