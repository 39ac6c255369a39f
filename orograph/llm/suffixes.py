"""Removal of long strings that an earlier document holds, by bounded interval expansion on a Burrows-Wheeler transform.

Bytes are removed that a string of ``least`` bytes covers which also starts in a document with a
smaller id. Strings of that length are grouped by a key that equal ones share: the least hash of
their grams. Neighbouring strings with one key make a piece of text, and only pieces whose key
occurs in several documents leave their chunk, each different piece once a chunk, with the smallest
id that holds it there.

All pieces of a key meet in one bucket, which sorts their suffixes as far as needed, takes the
Burrows-Wheeler transform and derives the common prefixes of neighbouring suffixes by increasing
length: breadth first, the intervals of all strings of a length are extended backward by one byte,
each border that appears for the first time having the length reached (Beller, Gog, Ohlebusch and
Schnattinger). The search stops at ``least``: what is without a border then agrees in that many
bytes. The smallest id of each such class goes back to the chunks, which cut their documents.

A key with very many pieces (over ``hot``) isn't brought together: each string under it is a key of
its own, whose smallest id Spark aggregates. Keys only group, so their collisions cost time and
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import slices, spans, stored
from orograph.llm.lmscore import squeezed, unsqueezed

#: Bytes of the strings, and of the grams whose hashes make the keys: words of eight bytes at these places.
LEAST, GRAM, PARTS = 50, 20, (0, 8, 12)
#: Bytes of documents packed into a chunk, and of a chunk that are hashed at a time.
PACKED, BLOCK = 1 << 23, 1 << 20
#: Strings of a piece, at most.
LONGEST = 64
#: Bits of a key.
KEY_BITS = 48
#: Buckets, at least; bytes of documents for each bucket of keys and bytes of pieces for each bucket of pieces.
BUCKETS, KEYS_OF, PIECES_OF = 64, 1 << 25, 1 << 24
#: Parts of a bucket that are sorted one after the other.
SUBS = 16
#: Pieces of a key, over all chunks, above which its strings are keys of their own.
HOT = 1 << 16
#: Ends a piece; no byte of UTF-8.
END = 0xFF
_LAST = (1 << 63) - 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

Pieces = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def packed(rows: DataFrame) -> DataFrame:
    """(chunk, ids, size, data) from (id, text): documents of about PACKED bytes, squeezed together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, 1, PACKED)):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            ends = pa.array([0, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c) for c in (batch.column(0), pa.array(list(map(len, texts)), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists, pa.array([squeezed(b"".join(texts))], pa.binary())], ["chunk", "ids", "size", "data"])
            at += 1

    return rows.mapInArrow(run, "chunk long, ids array<long>, size array<long>, data binary")


def keys_of(text: np.ndarray) -> np.ndarray:
    """The least hash of the grams of each string of LEAST bytes."""
    n = len(text) - GRAM + 1
    word = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,))
    h = word[:n] * _M[0]
    for at, m in zip(PARTS[1:], _M[1:], strict=True):
        h ^= h >> np.uint64(31)
        h += word[at : at + n]
        h *= m
    h ^= h >> np.uint64(32)
    width, of = 1, LEAST - GRAM + 1
    while 2 * width <= of:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (of - width)], h[of - width :])


def pieces(text: np.ndarray, size: np.ndarray) -> Pieces:
    """(first string, number of strings, key, document): neighbouring strings of a document with one key, LONGEST at most."""
    ends = np.cumsum(size)
    begins = ends - size
    out: list[Pieces] = []
    for a in range(0, len(text) - LEAST + 1, BLOCK):
        key = keys_of(text[a : a + BLOCK + LEAST - 1])
        m = len(key)
        # a document's strings are those that end in it
        lo, hi = np.clip(begins - a, 0, m), np.clip(ends - LEAST + 1 - a, 0, m)
        some = np.flatnonzero(lo < hi)
        inside = np.zeros(m + 1, np.int8)
        np.add.at(inside, lo[some], 1)
        np.add.at(inside, hi[some], -1)
        valid = np.cumsum(inside[:m]) > 0
        fresh = np.r_[True, key[1:] != key[:-1]]
        fresh[lo[some]] = True
        fresh[1:] |= valid[1:] & ~valid[:-1]
        first = np.flatnonzero(fresh & valid)
        stop = np.flatnonzero(np.r_[fresh[1:] | ~valid[1:], True] & valid) + 1
        n = stop - first
        k = key[first] >> np.uint64(64 - KEY_BITS)
        doc = np.searchsorted(ends, first + a, side="right")
        parts = -(-n // LONGEST)
        if (parts > 1).any():
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, k, doc = np.repeat(first, parts) + within * LONGEST, np.repeat(k, parts), np.repeat(doc, parts)
            n = np.minimum(np.repeat(n, parts) - within * LONGEST, LONGEST)
        out.append((first + a, n, k, doc))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))  # type: ignore[return-value]


def mixed(key: np.ndarray) -> np.ndarray:
    x = key * _M[0]
    return ((x ^ (x >> np.uint64(29))) * _M[1]) >> np.uint64(20)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, squeezed byte by byte."""
    x = np.ascontiguousarray(x)
    return squeezed(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def _from_planes(data: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(unsqueezed(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


class Chunk:
    """A chunk and its pieces; keys in the order in which they are sent, and where each bucket's begin."""

    def __init__(self, row: dict, buckets: int):
        self.ids = [None if x is None else int(x) for x in row["ids"].as_py()]
        self.size = np.asarray(row["size"].values).astype(np.int64)
        self.text = np.frombuffer(unsqueezed(row["data"].as_py()), np.uint8)
        # without an id after all others, and no smaller than another without
        self.rank = np.array([_LAST if x is None else x for x in self.ids], np.int64)
        self.first, self.n, self.key, self.doc = pieces(self.text, self.size)
        self.keys, self.at = np.unique(self.key, return_inverse=True)
        bucket = (mixed(self.keys) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.buckets = bucket[self.order]

    def counted(self) -> np.ndarray:
        """For each key twice its number of different pieces here, at most, plus one if several documents have it."""
        low, high = np.full(len(self.keys), _LAST), np.full(len(self.keys), -_LAST - 1)
        np.minimum.at(low, self.at, self.rank[self.doc])
        np.maximum.at(high, self.at, self.rank[self.doc])
        h = mixed(self.key ^ (self.n.astype(np.uint64) << np.uint64(KEY_BITS)))
        word = np.ndarray((max(0, len(self.text) - 7),), "<u8", self.text, strides=(1,))
        for at in range(0, LEAST + LONGEST - 1, 8):
            h = (h ^ (h >> np.uint64(31))) * _M[1] + word[self.first + np.minimum(at, self.n + LEAST - 1 - 8)]
        h, first = np.unique((h ^ (h >> np.uint64(29))) * _M[2], return_index=True)
        return (2 * np.bincount(self.at[first], minlength=len(self.keys)) + (low < high)).astype(np.uint32)

    def verdicts(self, told: list[tuple[int, bytes]]) -> np.ndarray:
        """Of each piece: 0 where one document alone has the key, 1, or 2 for hot keys; told: of the buckets."""
        flat = np.frombuffer(b"".join(unsqueezed(x) for _, x in sorted(told)), np.uint8)
        of = np.empty(len(self.keys), np.uint8)
        of[self.order] = flat
        return of[self.at]

    def cut(self, first: np.ndarray, n: np.ndarray) -> pa.DictionaryArray:
        """The text of pieces, each different one once."""
        size = n + LEAST - 1
        return _binary(_gathered(self.text, first, size), size).dictionary_encode()


def _gathered(text: np.ndarray, first: np.ndarray, size: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    out = [np.zeros(0, np.uint8)]
    for a in range(0, len(first), step):
        f, s = first[a : a + step], size[a : a + step]
        out.append(text[np.repeat(f - (np.cumsum(s) - s), s) + np.arange(s.sum())])
    return np.concatenate(out)


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of large binaries."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2], np.uint8)[at[0] : at[-1]], np.diff(at)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


# ---- keys --------------------------------------------------------------------------------------


def keys_sent(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, keys, counts): the different keys of a chunk, by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                c = Chunk(row, buckets)
                count = c.counted()[c.order]
                keys = c.keys[c.order]
                parts = spans(c.buckets)
                delta = [_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"].as_py()] * len(parts), pa.int64()), pa.array([int(c.buckets[a]) for a, _ in parts], pa.int64()), pa.array(delta, pa.binary()), pa.array([_planes(count[a:b]) for a, b in parts], pa.binary())],
                    ["chunk", "bucket", "keys", "counts"],
                )

    return chunks.mapInArrow(run, "chunk long, bucket long, keys binary, counts binary")


def keys_told(sent: DataFrame, hot: int) -> DataFrame:
    """(chunk, bucket, told, pieces, hot): a verdict for each key that was sent, how many pieces go on and how many keys are hot."""

    def run(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()]
        counts = np.concatenate([_from_planes(x, np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        chunks = np.bincount(at)
        several = np.bincount(at, counts & 1) > 0
        total = np.bincount(at, counts >> 1)
        verdict = np.where((chunks > 1) | several, np.where(total > hot, 2, 1), 0).astype(np.uint8)[at]
        edge = np.cumsum([0, *map(len, keys)]).tolist()
        parts = list(zip(edge, edge[1:], strict=False))
        n = [int((counts[a:b] >> 1)[verdict[a:b] == 1].sum()) for a, b in parts]
        return pa.table(
            [t.column("chunk"), t.column("bucket"), pa.array([squeezed(verdict[a:b].tobytes()) for a, b in parts], pa.binary()), pa.array(n, pa.int64()), pa.array([int((verdict[a:b] == 2).sum()) for a, b in parts], pa.int64())],
            ["chunk", "bucket", "told", "pieces", "hot"],
        )

    return sent.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, told binary, pieces long, hot long")


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k] for name in batch.schema.names}


# ---- pieces ------------------------------------------------------------------------------------


class Shared:
    """The different pieces of a chunk that other documents may hold, by bucket and part of it."""

    def __init__(self, c: Chunk, verdict: np.ndarray, buckets: int):
        self.some = np.flatnonzero(verdict == 1)
        coded = c.cut(c.first[self.some], c.n[self.some])
        code, self.different = np.asarray(coded.indices), coded.dictionary
        h = np.zeros(len(self.different), np.uint64)
        h[code] = mixed(c.key[self.some])
        where = (h % np.uint64(buckets)).astype(np.int64) * SUBS + (h // np.uint64(buckets) % np.uint64(SUBS)).astype(np.int64)
        self.order = np.argsort(where, kind="stable")
        self.where = where[self.order]
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        #: of each piece its place among the different ones, in the order in which they are sent
        self.code = place[code]
        self.doc = np.full(len(self.order), _LAST)
        np.minimum.at(self.doc, self.code, c.rank[c.doc[self.some]])


def pieces_sent(chunks: DataFrame, told: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    """(chunk, bucket, parts, size, docs, data): the different pieces of a chunk, by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        for row in _rows(left):
            c = Chunk(row, buckets[0])
            s = Shared(c, c.verdicts(list(zip(right.column("bucket").to_pylist(), right.column("told").to_pylist(), strict=True))), buckets[1])
            data, size = _flat(s.different.take(pa.array(s.order)))
            ends = np.cumsum(size)
            bucket = s.where // SUBS
            for a, b in spans(bucket):
                out[0].append(row["chunk"].as_py())
                out[1].append(int(bucket[a]))
                out[2].append(np.bincount(s.where[a:b] % SUBS, minlength=SUBS).tolist())
                out[3].append(_planes(size[a:b].astype(np.uint8)))
                out[4].append(_planes(s.doc[a:b]))
                out[5].append(squeezed(data[ends[a] - size[a] : ends[b - 1]].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["chunk", "bucket", "parts", "size", "docs", "data"])

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, "chunk long, bucket long, parts array<long>, size binary, docs binary, data binary")


def sorted_suffixes(text: np.ndarray, left: np.ndarray, upto: int) -> np.ndarray:
    """Suffixes by their first upto bytes at least, ended by END; left: bytes of each suffix before END."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    short = np.flatnonzero(left < 7)
    key[short] &= ~np.uint64(0) << (np.uint64(56) - np.uint64(8) * left[short].astype(np.uint64))
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    group = np.repeat(starts, np.diff(np.r_[starts, n]))
    rank[order] = group
    h = 8
    while h < upto:
        many = np.diff(np.r_[starts, n]) > 1
        at = np.flatnonzero(np.repeat(many, np.diff(np.r_[starts, n])))
        if not len(at):
            break
        own = order[at]
        beyond = np.where(left[own] >= h, rank[np.minimum(own + h, n - 1)] + 1, 0)
        both = rank[own].astype(np.uint64) << np.uint64(32) | beyond.astype(np.uint64)
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[at] = own
        fresh = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        rank[own] = np.repeat(at[fresh], np.diff(np.r_[fresh, len(at)]))
        starts = np.union1d(starts, at[fresh])
        h *= 2
    return order


def borders(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Where a suffix agrees with the one before it in fewer than least bytes: by breadth-first backward extension."""
    n = len(order)
    before = text[order - 1]  # the first suffix of all follows the last END
    by_byte = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[by_byte] = np.arange(n)
    heads = np.zeros(n + 1, bool)
    heads[np.r_[0, np.cumsum(np.bincount(before, minlength=256))]] = True
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    owner, seen = np.empty(n, np.int32), np.zeros(n, bool)
    start, stop = np.array([0]), np.array([n])
    for length in range(least):
        size = stop - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = np.repeat(np.arange(len(size), dtype=np.int32), size)
        if length:  # no string goes on before the beginning of a piece
            on = before[at] != END
            at, own = at[on], own[on]
        if not len(at):
            break
        to = back[at]
        owner[to] = own
        seen[to] = True
        to = np.flatnonzero(seen)
        seen[to] = False
        own = owner[to]
        split = (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | heads[to[1:]]
        first, last = to[np.r_[True, split]], to[np.r_[split, True]] + 1
        fresh = ~border[last]
        border[last[fresh]] = True
        start, stop = first[fresh], last[fresh]
    return border[:n]


def least_docs(data: np.ndarray, size: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each string of least bytes in different pieces, in their order, the smallest doc of a piece that holds it."""
    ends = np.cumsum(size + 1)
    text = np.empty(int(ends[-1]), np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside], text[~inside] = data, END
    left = np.repeat(ends - 1, size + 1) - np.arange(len(text))
    order = sorted_suffixes(text, left, least)
    whole = left >= least
    docs = np.where(whole, np.repeat(doc, size + 1), _LAST)[order]
    starts = np.flatnonzero(borders(text, order, least))
    out = np.empty(len(text), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.r_[starts, len(text)]))
    return out[whole]


def pieces_told(sent: DataFrame, least: int = LEAST) -> DataFrame:
    """(chunk, bucket, lengths, docs): the least doc of each string of the pieces that a chunk sent, as runs of equal ones."""

    def run(t: pa.Table) -> pa.Table:
        size = [_from_planes(x, np.uint8).astype(np.int64) for x in t.column("size").to_pylist()]
        docs = [_from_planes(x, np.int64) for x in t.column("docs").to_pylist()]
        parts = [np.cumsum([0, *x]) for x in t.column("parts").to_pylist()]
        data = [np.frombuffer(unsqueezed(x), np.uint8) for x in t.column("data").to_pylist()]
        ends = [np.r_[0, np.cumsum(s)] for s in size]
        told: list[list[np.ndarray]] = [[] for _ in size]
        for k in range(SUBS):
            cuts = [(p[k], p[k + 1]) for p in parts]
            some = [_binary(d[e[a] : e[b]], s[a:b]) for (a, b), d, e, s in zip(cuts, data, ends, size, strict=True)]
            coded = pa.concat_arrays(some).dictionary_encode()
            if not len(coded):
                continue
            code = np.asarray(coded.indices)
            least_doc = np.full(len(coded.dictionary), _LAST)
            np.minimum.at(least_doc, code, np.concatenate([d[a:b] for (a, b), d in zip(cuts, docs, strict=True)]))
            flat, n = _flat(coded.dictionary)
            best = least_docs(flat, n, least_doc, least)
            n = n - least + 1
            begin = np.cumsum(n) - n
            at = 0
            for j, (a, b) in enumerate(cuts):
                own = code[at : at + b - a]
                at += b - a
                told[j].append(_taken(best, begin[own], n[own]))
        lengths, values = [], []
        for x in told:
            flat = np.concatenate(x)
            runs = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            lengths.append(_planes(np.diff(np.r_[runs, len(flat)]).astype(np.uint32)))
            values.append(_planes(flat[runs]))
        return pa.table([t.column("chunk"), t.column("bucket"), pa.array(lengths, pa.binary()), pa.array(values, pa.binary())], ["chunk", "bucket", "lengths", "docs"])

    return sent.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, lengths binary, docs binary")


def _taken(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """x at n places from each first on."""
    return x[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


# ---- strings of hot keys -----------------------------------------------------------------------


def hot_strings(chunks: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """(chunk, string, doc): the different strings of a chunk under hot keys, with the smallest doc there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        strings, docs, of = [pa.array([], pa.large_binary())], [np.zeros(0, np.int64)], []
        for row in _rows(left):
            c = Chunk(row, buckets)
            some = np.flatnonzero(c.verdicts(list(zip(right.column("bucket").to_pylist(), right.column("told").to_pylist(), strict=True))) == 2)
            coded = c.cut(_taken(np.arange(len(c.text)), c.first[some], c.n[some]), np.ones(c.n[some].sum(), np.int64))
            doc = np.full(len(coded.dictionary), _LAST)
            np.minimum.at(doc, np.asarray(coded.indices), np.repeat(c.rank[c.doc[some]], c.n[some]))
            strings.append(coded.dictionary)
            docs.append(doc)
            of += [row["chunk"].as_py()] * len(doc)
        return pa.table([pa.array(of, pa.int64()), pa.concat_arrays(strings).cast(pa.binary()), pa.array(np.concatenate(docs))], ["chunk", "string", "doc"])

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, "chunk long, string binary, doc long")


# ---- documents ---------------------------------------------------------------------------------


def cut_documents(chunks: DataFrame, replies: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    """(id, n_bytes, spans, kept); replies: (chunk, kind, bucket, a, b) of keys, pieces and strings."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        told = {k: right.filter(pc.equal(right.column("kind"), k)).sort_by("bucket") for k in ("key", "piece", "string")}
        for row in _rows(left):
            c = Chunk(row, buckets[0])
            verdict = c.verdicts(list(zip(told["key"].column("bucket").to_pylist(), told["key"].column("a").to_pylist(), strict=True)))
            s = Shared(c, verdict, buckets[1])
            gone = np.zeros(len(c.text) + 1, bool)
            piece = told["piece"]
            best = [np.repeat(_from_planes(b, np.int64), _from_planes(a, np.uint32)) for a, b in zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), strict=True)]
            best = np.concatenate([np.zeros(0, np.int64), *best])
            n = np.zeros(len(s.order), np.int64)
            n[s.code] = c.n[s.some]
            begin = np.cumsum(n) - n
            for a in range(0, len(s.some), 1 << 17):
                own, code = s.some[a : a + (1 << 17)], s.code[a : a + (1 << 17)]
                earlier = _taken(best, begin[code], n[code]) < np.repeat(c.rank[c.doc[own]], c.n[own])
                gone[_taken(np.arange(len(c.text)), c.first[own], c.n[own])[earlier]] = True
            if len(hot := np.flatnonzero(verdict == 2)):
                doc = dict(zip(told["string"].column("a").to_pylist(), told["string"].column("b").to_pylist(), strict=True))
                at = _taken(np.arange(len(c.text)), c.first[hot], c.n[hot])
                coded = c.cut(at, np.ones(len(at), np.int64))
                least = np.array([int.from_bytes(doc[x], "big", signed=True) for x in coded.dictionary.to_pylist()], np.int64)
                gone[at[least[np.asarray(coded.indices)] < np.repeat(c.rank[c.doc[hot]], c.n[hot])]] = True
            out.append(_cut(c, gone, kind))
        return pa.concat_tables(out) if out else _none(kind)

    schema = "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def _none(kind: pa.DataType) -> pa.Table:
    return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), kind, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def _cut(c: Chunk, gone: np.ndarray, kind: pa.DataType) -> pa.Table:
    """The documents of a chunk without the bytes that the strings cover which begin where gone is true."""
    edge = np.flatnonzero(np.diff(gone, prepend=False))
    start, stop = edge[::2], edge[1::2] + LEAST - 1
    ends = np.cumsum(c.size)
    doc = np.searchsorted(ends, start, side="right")
    fresh = np.r_[True, (start[1:] > stop[:-1]) | (doc[1:] != doc[:-1])][: len(start)]
    last = np.r_[fresh[1:], True][: len(start)]
    start, stop, doc = start[fresh], stop[last], doc[fresh]
    cover = np.zeros(len(c.text) + 1, np.int8)
    cover[start] += 1
    np.add.at(cover, stop, -1)
    keep = np.cumsum(cover[:-1], dtype=np.int8) == 0
    left = c.size - np.bincount(doc, stop - start, len(c.size)).astype(np.int64)
    begins = ends - c.size
    struct = pa.StructArray.from_arrays([pa.array(start - begins[doc]), pa.array(stop - begins[doc])], fields=[kind.value_type.field(0), kind.value_type.field(1)])
    at = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(c.size)))].astype(np.int32)
    kept = _binary(c.text[keep], left).cast(pa.binary())
    return pa.table([pa.array(c.ids, pa.int64()), pa.array(c.size), pa.ListArray.from_arrays(pa.array(at), struct), kept], ["id", "n_bytes", "spans", "kept"])


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, spans, kept) for every row of docs.

    Texts are UTF-8 bytes. spans: (start, end) of the maximal runs of bytes that are covered by
    strings of 50 bytes which also start in a row with a smaller id; strings overlap, and are judged
    on the texts as they come. kept: the bytes that are left, joined. Null and empty texts have no
    bytes. Ids become longs; rows without one come after all others, rows with one id are no smaller
    than each other, so that repeated rows don't remove one another. Other columns are ignored.
    Matches never cross rows. hot: pieces of a key above which its strings are aggregated one by one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    chunks = stored(packed(rows), "suffix-chunks")
    total = chunks.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n_keys = max(BUCKETS, total // KEYS_OF)
    told = stored(keys_told(keys_sent(chunks, n_keys), hot), "suffix-keys")
    going = told.agg(F.sum("pieces"), F.sum("hot")).first()
    buckets = (n_keys, max(BUCKETS, (going[0] or 0) * (LEAST + GRAM) // PIECES_OF))
    named = lambda df, kind, a, b: df.select("chunk", F.lit(kind).alias("kind"), F.col("bucket"), F.col(a).alias("a"), F.col(b).alias("b"))
    best = stored(pieces_told(pieces_sent(chunks, told.select("chunk", "bucket", "told"), buckets)), "suffix-pieces")
    replies = named(told, "key", "told", "told").union(named(best, "piece", "lengths", "docs"))
    if going[1]:
        strings = stored(hot_strings(chunks, told.select("chunk", "bucket", "told"), n_keys), "suffix-strings")
        least = strings.groupBy("string").agg(F.min("doc").alias("least"))
        far = strings.select("chunk", "string").join(least, "string").select("chunk", "string", F.to_binary(F.lpad(F.hex("least"), 16, "0"), F.lit("hex")).alias("least"), F.lit(0).cast("long").alias("bucket"))
        replies = replies.union(named(far, "string", "string", "least"))
    return cut_documents(chunks, replies, buckets).withColumnRenamed("id", id_col)


def digests(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of repeats_removed(): how many bytes and spans went, and the SHA-256 of what is left."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return cut.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
