"""Hard negatives by distributed radix selection over integer scores.

Scores are exact integer inner products of scaled vectors. For each anchor and positive, the
negatives worth learning from score within a window below the positive; the best of them are
found without sorting or moving scores. Every block of rows counts, for every window of a block of
anchors, how many scores fall in each of 256 equal parts of the window; the sums tell in which
part the kth score lies; that part is divided again, digit by digit, until it holds no more than
is asked for, or few; ties of one score are divided by id in the same way. Only then do rows
that qualify leave their blocks. The positives are found the same way, in a window of all scores.

Anchors are a stated set of queries, compared with all rows in blocks: a task holds one block of
each. Nothing but counts of windows still open reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.common import cut, stored

#: Scores of digits that are counted at once.
DIGIT_BITS = 8
#: Rows that a window may send without being divided further.
GATHERED = 32
#: Rows and anchors of a block, about, and blocks that one task of the packing makes.
ROWS, ANCHORS, PACKING = 4096, 1024, 8
#: Windows of a block that are held against all its rows at a time.
STEP = 256
_TOP = (1 << 63) - 1

STATE = "win long, anchor long, aid long, label string, vec binary, same boolean, wanted int, top long, lo long, hi long, ilo long, ihi long, above long, need long, done boolean"


def _scaled(scale: float):
    """For mapInArrow over (id, label, vec): (id, label, vec) with whole components as doubles, without rows that take no part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, v in enumerate(batch.column(2).to_pylist()):
                if v is None:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * np.array([np.nan if c is None else c for c in v], np.float64))
                if np.isfinite(x).all():
                    keep.append(k)
                    out.append((x + 0.0).tobytes())
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, pa.binary())], ["id", "label", "vec"])

    return run


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, slot, ...) before the columns: the rows of a task go to PACKING blocks in turn."""
    first, n = TaskContext.get().partitionId() * PACKING, 0
    for batch in batches:
        at = np.arange(n, n + len(batch))
        n += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(first + at % PACKING), pa.array(at // PACKING), *batch.columns], ["block", "slot", *batch.schema.names])


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(block, slot, id, label, vec), written, with blocks of about so many rows numbered from 0; and how many there are."""
    parts = max(1, -(-rows.count() // (size * PACKING)))
    dealt = rows.repartition(parts).mapInArrow(_dealt, "block long, slot long, id long, label string, vec binary")
    return stored(dealt, name), parts * PACKING


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole doubles, kept within a long."""
    width = a.shape[1]
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    # products and all their partial sums below 2^53 are exact in doubles
    if np.abs(a).max() * np.abs(b).max() * width < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(c) for c in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -_TOP, _TOP).astype(np.int64)


def _scores(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, rows, scores, which may be taken) for parts of the windows and the rows of the same width; ids of rows ascend."""
    left, right = left.sort_by([("anchor", "ascending"), ("win", "ascending")]), right.sort_by("id")
    label = np.unique(left.column("label").to_pylist() + right.column("label").to_pylist(), return_inverse=True)[1]
    label, other = label[: len(left)], label[len(left) :]
    anchor, aid, same = (np.asarray(left.column(c)) for c in ("anchor", "aid", "same"))
    ids, vecs, theirs = np.asarray(right.column("id")), left.column("vec").to_pylist(), right.column("vec").to_pylist()
    mine, width = np.fromiter(map(len, vecs), np.int64, len(vecs)), np.fromiter(map(len, theirs), np.int64, len(theirs))
    for w in np.unique(mine).tolist():
        rows = np.flatnonzero(width == w)
        own = np.flatnonzero(mine == w)
        if not len(rows):
            continue
        b = np.frombuffer(b"".join(theirs[k] for k in rows), np.float64).reshape(len(rows), -1)
        for at in range(0, len(own), STEP):
            part = own[at : at + STEP]
            _, first, k = np.unique(anchor[part], return_index=True, return_inverse=True)
            a = np.frombuffer(b"".join(vecs[part[i]] for i in first), np.float64).reshape(len(first), -1)
            fits = (label[part][:, None] == other[rows][None, :]) == same[part][:, None]
            yield part, rows, _exact(a, b)[k], fits & (aid[part][:, None] != ids[rows][None, :])


def _shift(span: np.ndarray) -> np.ndarray:
    """By how many bits to shift numbers up to span (unsigned) so that they have DIGIT_BITS at most."""
    return np.array([max(0, int(x).bit_length() - DIGIT_BITS) for x in span], np.uint64)


def _counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """(win, digit, low, high, n): rows of the block in each part of each window; the best part has the least digit."""
    left = left.sort_by([("anchor", "ascending"), ("win", "ascending")])
    win, lo, hi, ilo, ihi = (np.asarray(left.column(c)) for c in ("win", "lo", "hi", "ilo", "ihi"))
    by_id = lo == hi
    # differences wrap around to what they are as unsigned numbers
    span = np.where(by_id, ihi.view(np.uint64) - ilo.view(np.uint64), hi.view(np.uint64) - lo.view(np.uint64))
    shift = _shift(span)
    ids = np.sort(np.asarray(right.column("id")))
    out = []
    for part, rows, score, fits in _scores(left, right):
        fits &= (score >= lo[part][:, None]) & (score <= hi[part][:, None])
        w, r = np.nonzero(fits)
        at = part[w]
        near = (ids[rows[r]] >= ilo[at]) & (ids[rows[r]] <= ihi[at])
        w, r, at = w[near], r[near], at[near]
        key = np.where(by_id[at], ids[rows[r]].view(np.uint64) - ilo[at].view(np.uint64), hi[at].view(np.uint64) - score[w, r].view(np.uint64))
        found, n = np.unique((at << DIGIT_BITS) | (key >> shift[at]).astype(np.int64), return_counts=True)
        out.append((found >> DIGIT_BITS, found & ((1 << DIGIT_BITS) - 1), n))
    at, digit, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    near = digit.astype(np.uint64) << shift[at]
    far = np.minimum(near + ((np.uint64(1) << shift[at]) - np.uint64(1)), span[at])
    ids_, scores_ = ilo[at].view(np.uint64), hi[at].view(np.uint64)
    low = np.where(by_id[at], ids_ + near, scores_ - far).view(np.int64)
    high = np.where(by_id[at], ids_ + far, scores_ - near).view(np.int64)
    return pa.table([pa.array(win[at]), pa.array(digit.astype(np.int32)), pa.array(low), pa.array(high), pa.array(n.astype(np.int64))], ["win", "digit", "low", "high", "n"])


def _qualifying(left: pa.Table, right: pa.Table) -> pa.Table:
    """(win, id, score): rows of the block that a window takes, the best of them where more than it wants are equal."""
    left = left.sort_by([("anchor", "ascending"), ("win", "ascending")])
    win, wanted, top, lo, hi, ihi = (np.asarray(left.column(c)) for c in ("win", "wanted", "top", "lo", "hi", "ihi"))
    ids = np.sort(np.asarray(right.column("id")))
    out = []
    for part, rows, score, fits in _scores(left, right):
        fits &= (score >= lo[part][:, None]) & (score <= top[part][:, None])
        w, r = np.nonzero(fits)
        s, at = score[w, r], part[w]
        take = (s > hi[at]) | (ids[rows[r]] <= ihi[at])
        w, r, s, at = w[take], r[take], s[take], at[take]
        order = np.lexsort((ids[rows[r]], -s, at))
        r, s, at = r[order], s[order], at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        first = rank < np.maximum(wanted[at], GATHERED)
        out.append((win[at][first], ids[rows[r]][first], s[first]))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(x) for x in parts], ["win", "id", "score"])


def _met(windows: DataFrame, blocks: DataFrame, counts: tuple[int, int], run, schema: str) -> DataFrame:
    """run on every block of windows with every block of rows."""
    n_anchor, n_row = counts
    left = windows.withColumn("a", F.floor(F.col("anchor") / (1 << 32))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_row - 1)).cast("array<long>")))
    right = blocks.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1)).cast("array<long>"))).withColumnRenamed("block", "b")

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        return run(x, y) if len(x) and len(y) else run(x.slice(0, 0), y.slice(0, 0))

    return left.groupBy("a", "b").cogroup(right.select("a", "b", "id", "label", "vec").groupBy("a", "b")).applyInArrow(both, schema)


def selected(windows: DataFrame, blocks: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """(win, rank, id, score): the first rows of each window (see STATE), highest score first, then smallest id."""
    state = cut(windows)
    while not state.where("not done").isEmpty():
        counted = _met(state.where("not done"), blocks, counts, _counted, "win long, digit int, low long, high long, n long")
        summed = counted.groupBy("win", "digit", "low", "high").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("win").orderBy("digit"))
        reached = summed.withColumn("upto", upto).join(state.select("win", F.col("need").alias("asked")), "win").where(F.col("upto") >= F.col("asked"))
        part = reached.groupBy("win").agg(F.min_by(F.struct("low", "high", "n", "upto"), "digit").alias("part"))
        state = state.join(part, "win", "left")
        open_, by_id, p = ~F.col("done"), F.col("lo") == F.col("hi"), F.col("part")
        has = open_ & p.isNotNull()
        set_ = lambda name, change, when: F.when(has & when, change).otherwise(F.col(name)).alias(name)
        before = p["upto"] - p["n"]
        all_of_it = (p["n"] == F.col("need") - before) | (F.col("above") + p["upto"] <= GATHERED)
        single = (p["low"] == p["high"]) & by_id
        state = cut(state.select(
            "win", "anchor", "aid", "label", "vec", "same", "wanted", "top",
            set_("lo", p["low"], ~by_id), set_("hi", p["high"], ~by_id), set_("ilo", p["low"], by_id), set_("ihi", p["high"], by_id),
            set_("above", F.col("above") + before, F.lit(True)), set_("need", F.col("need") - before, F.lit(True)),
            (F.col("done") | p.isNull() | all_of_it | single).alias("done"),
        ))
    rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "id"))
    found = _met(state, blocks, counts, _qualifying, "win long, id long, score long").withColumn("rank", rank)
    return found.join(state.select("win", "wanted"), "win").where(F.col("rank") <= F.col("wanted")).select("win", "rank", "id", "score")


def hard_negatives(table: DataFrame, anchor: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which rows of table are anchors. Components become floor(scale * x), a score is the
    integer inner product with the anchor. An anchor's positives are the first rows of its label,
    its negatives for a positive the first rows of other labels with low to high hundredths of the
    positive's score; first by higher score, then smaller id. All, if there are fewer; a positive
    whose score is negative has no negatives. Rows whose id, label or vector is null, or with a null
    or non-finite component (scaled ones included), take no part; vectors of different length have
    no score. Rows with the anchor's own id are not among its positives and negatives. Repeated rows
    each count, as anchors too. A score beyond a long counts as the nearest long. Other columns are
    ignored. rows, anchors: of a block.
    """
    base = table.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
    shape = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")]
    whole = lambda df: df.select(*shape).mapInArrow(_scaled(scale), "id long, label string, vec binary")
    blocks, n_row = _blocks(whole(base), rows, "mined-rows")
    asked, n_anchor = _blocks(whole(base.where(anchor)), anchors, "mined-anchors")
    counts = (n_anchor, n_row)
    least, most = blocks.agg(F.min("id"), F.max("id")).first()

    def windows(df: DataFrame, same: bool, wanted: int) -> DataFrame:
        first = df.withColumns({"same": F.lit(same), "wanted": F.lit(wanted), "top": F.col("hi"), "ilo": F.lit(least).cast("long"), "ihi": F.lit(most).cast("long")})
        first = first.withColumns({"above": F.lit(0).cast("long"), "need": F.lit(wanted).cast("long"), "done": F.lit(False)})
        return first.select(*[F.col(name).cast(kind).alias(name) for name, kind in (x.split() for x in STATE.split(", "))])

    at = (F.col("block") * (1 << 32) + F.col("slot")).alias("anchor")
    asked = asked.select(at, F.col("id").alias("aid"), "label", "vec")
    reach = _reach(blocks, asked)
    every = asked.withColumns({"win": F.col("anchor"), "lo": F.lit(-reach), "hi": F.lit(reach)})
    best = selected(windows(every, True, positives), blocks, counts).withColumnsRenamed({"win": "anchor", "id": "positive_id", "score": "positive_score"})
    best = cut(best.withColumnRenamed("rank", "place"))
    s, h = F.col("positive_score"), lambda n: F.expr(f"positive_score div 100 * {n}")
    within = best.where(s >= 0).join(asked, "anchor").withColumns({
        "win": F.col("anchor") * 64 + F.col("place") if positives < 64 else F.expr("xxhash64(anchor, place)"),
        "lo": h(low) + F.expr(f"(positive_score % 100 * {low} + 99) div 100"), "hi": h(high) + F.expr(f"positive_score % 100 * {high} div 100"),
    }).where("lo <= hi")
    within = cut(within)
    found = selected(windows(within, False, negatives), blocks, counts)
    out = found.join(within.select("win", "aid", "positive_id", "positive_score"), "win")
    return out.select(F.col("aid").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _reach(blocks: DataFrame, asked: DataFrame) -> int:
    """No score is larger, or less than its negative: by the products of the greatest norms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [float(np.linalg.norm(np.frombuffer(v, np.float64))) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([max(norm, default=0.0)])], ["norm"])

    norm = [df.select("vec").mapInArrow(run, "norm double").agg(F.max("norm")).first()[0] or 0.0 for df in (blocks, asked)]
    # rounded up by more than the norms' own rounding
    return min(_TOP, int(norm[0] * norm[1] * (1 + 1e-9)) + 1) if np.isfinite(norm[0] * norm[1]) else _TOP
