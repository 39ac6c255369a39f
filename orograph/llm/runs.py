"""Periodic runs of words: stretches that repeat a period at least three times.

The runs of a text are found as Kolpakov and Kucherov do. A suffix automaton of words gives the
Lempel-Ziv factors; Main's algorithm finds the runs that touch a border between two factors, by
common extensions to the left and to the right of it; a run within a factor is copied from the
factor's earlier occurrence.

A run of at least 24 words and three periods holds each of its spans of eight words at least
twice, so only stretches all of whose spans of eight words recur in the text are searched. Such a
stretch holds every run that it touches, neighbours included, so nothing is lost by that.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import as_bytes, fresh, slices, spans

#: Words of the shortest run, and the periods that it holds.
LEAST, PERIODS = 24, 3
#: Words of a span that recurs within every run: LEAST is at least three times as long, so that PERIODS * q - SPAN + 1 >= 2 * q from q = SPAN - 1 on.
SPAN = 8
#: Bytes of text whose words are numbered together.
PACKED = 1 << 21

_MIX = np.uint64(0x9E3779B97F4A7C15)


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1): the Lempel-Ziv factors, which may overlap their occurrence."""
    link, length, first, step = [-1], [0], [-1], [{}]
    last = state = start = held = 0
    out = []
    for i, c in enumerate(x):
        # the automaton holds x[:i]; state is that of x[start:i], a string of held words
        if c in step[state]:
            state = step[state][c]
            held += 1
        else:
            if held:
                out.append((start, i, first[state] - held + 1))
                start, held = i, 0
            state = step[0].get(c, 0)
            if state:
                held = 1
            else:
                out.append((i, i + 1, -1))
                start = i + 1
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        first.append(i)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
                if state == q and held <= length[copy]:
                    state = copy
        last = new
    if held:
        out.append((start, len(x), first[state] - held + 1))
    return out


def extensions(a: list[int]) -> list[int]:
    """For each place of a how far what begins there agrees with a's own beginning."""
    n = len(a)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(x: list[int], low: int, b: int, high: int, least: int, periods: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs within x[low:high] that touch the border b, by their extensions from it."""
    left, right = x[low:b][::-1], x[b:high]
    n, m = len(left), len(right)
    most = (n + m) // periods
    gap = [-1]  # agrees with no word
    after, before = extensions(right), extensions(left)
    # what ends at b + q agrees to the left with what ends at b; what begins at b - q agrees to the right with what begins at b
    to_left, to_right = extensions(left + gap + right[::-1] + left), extensions(right + gap + left[::-1] + right)
    for q in range(1, most + 1):
        if q <= m:
            r, s = after[q] if q < m else 0, to_left[n + 1 + m - q]
            if r + s + q >= periods * q and r + s + q >= least:
                yield b - s, b + q + r, q
        if q <= n:
            s, r = before[q] if q < n else 0, to_right[m + 1 + n - q]
            if r + s + q >= periods * q and r + s + q >= least:
                yield b - q - s, b + r, q


def runs(x: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every maximal run of x, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []

    def keep(s: int, e: int, q: int) -> None:
        if (s, e) not in found:
            insort(order, (s, e))
        found[s, e] = min(q, found.get((s, e), q))

    cut = factors(x)
    for k, (b, c, earlier) in enumerate(cut):
        a = cut[k - 1][0] if k else b
        # a run that ends in this factor and begins before it reaches less than that far to the left
        low = max(0, b - 2 * (b - a) - (c - b))
        if c - low >= least:
            for s, e, q in touching(x, low, b, c, least, periods):
                # one that the window's borders cut belongs to another factor, and one that goes on past c to a later border
                if (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == len(x) or x[e] != x[e - q]):
                    keep(s, e, q)
        if earlier >= 0 and c - b > least:
            shift = b - earlier
            at = bisect_left(order, (earlier + 1, 0))
            while at < len(order) and order[at][0] < c - shift:
                s, e = order[at]
                if e < c - shift:
                    keep(s + shift, e + shift, found[s, e])
                at += 1
    n = len(x)
    if cut and n - cut[-1][0] >= least:
        for s, e, q in touching(x, cut[-1][0], n, n, least, periods):
            if s == 0 or x[s - 1] != x[s - 1 + q]:
                keep(s, e, q)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def stretches(word: np.ndarray, owner: np.ndarray, span: int = SPAN, least: int = LEAST) -> list[tuple[int, int]]:
    """Maximal (first, end) with least words, all of whose spans occur twice in their text at least; owner ascends.

    Spans are told apart by a hash: two that share one only make a stretch longer, which costs time
    and changes no run.
    """
    if len(word) < least:
        return []
    h = word.astype(np.uint64) * _MIX
    for k in (1, 2, 4):
        h = (h[:-k] ^ (h[:-k] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[k:]
    whole = owner[: len(h)] == owner[span - 1 :]
    h = (h ^ (h >> np.uint64(29))) * _MIX ^ owner[: len(h)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h) + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again[:-1] &= whole
    edge = np.flatnonzero(np.diff(again, prepend=False))
    return [(a, b + span - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a + span - 1 >= least]


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in (part for whole in batches for part in slices(whole, 1, PACKED)):
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        texts = [t.split() if t else [] for t in as_bytes(batch.column(1))]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        word = np.concatenate([np.fromiter(map(index.__getitem__, t), np.int64, len(t)) for t in texts])
        begin = np.cumsum(size) - size
        found: list[list[dict[str, int]]] = [[] for _ in texts]
        gone: dict[int, list[tuple[int, int]]] = defaultdict(list)
        owner = np.repeat(np.arange(len(texts)), size)
        for a, b in stretches(word, owner):
            k = int(owner[a])
            at = a - int(begin[k])
            for s, e, q in runs(word[a:b].tolist()):
                found[k].append({"start": at + s, "length": e - s, "period": q})
                gone[k].append((at + s + q, at + e))
        for k, parts in gone.items():
            kept = np.ones(len(texts[k]), bool)
            for a, b in parts:
                kept[a:b] = False
            texts[k] = [texts[k][i] for i in np.flatnonzero(kept).tolist()]
        collapsed = pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(found, kind), collapsed], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed) for every row of docs.

    Words are what stands between ASCII white space, numbered from 0. runs: (start, length, period)
    of every stretch with smallest period q, of at least 24 words and three periods, that neither
    neighbour continues; by start, then period. Runs may overlap. collapsed: the words that no run
    holds after its first q, joined by one space. A null or empty text has no words, no runs and an
    empty collapsed text. Each row stands for itself: null ids and repeated rows are kept, other
    columns ignored. Texts are taken whole, each in one task, with memory in proportion to its words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_searched, f"id {rows.dtypes[0][1]}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeats put into the tenth of the texts whose crc32 of the id is divisible by 10.

    With g = crc32 / 10 and n words, each word i from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) / (3 + g % 8). Other texts stay as they are, nulls and texts without words too.
    """
    h, words = fresh(docs, "h"), fresh(docs, "words")
    out = docs.withColumn(h, F.crc32(F.col(id_col).cast("string").cast("binary")))
    out = out.withColumn(words, F.when(F.col(h) % 10 == 0, F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n, g = F.size(words), F.floor(F.col(h) / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # struct of a and p once a row, as every word needs them
    out = out.withColumn(h, F.when(n > 0, F.struct(a.alias("a"), p.alias("p"))))
    at = lambda i: F.when(i < F.col(h)["a"], i).otherwise(F.col(h)["a"] + (i - F.col(h)["a"]) % F.col(h)["p"])
    made = F.array_join(F.transform(words, lambda _, i: F.get(words, at(i))), " ")
    return out.withColumn(text_col, F.when(F.col(h).isNotNull(), made).otherwise(F.col(text_col))).drop(h, words)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of periodic_runs(): n_runs, the run of the greatest length / period, and SHA-256 of the runs and of what is left."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    kind = "struct<start:long,length:long,period:long>"
    best = F.reduce("runs", F.lit(None).cast(kind), better)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    out = found.withColumn("best", best)
    return out.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
