"""SimHash near-duplicates: fingerprints, pivot distance tables, exact links, components.

A fingerprint bit is 1 where over half of a text's word-shingle hashes have it. Two fingerprints
link where they differ in at most a few bits. The distances of every fingerprint to a table of
reference fingerprints (pivots) are worked out once; by the triangle inequality a pair whose
largest coordinate difference exceeds the radius can't link and is discarded, and what survives
is verified bit by bit.

Pairs are formed only among fingerprints that agree in some key of bits, chosen so that every
pair within the radius agrees in one of them. A run of one key is compared in a stream, sorted
by key; it gives the edges of a minimum spanning forest, never all its pairs. A key with more
fingerprints than ``cap`` goes another exact way (see ``ball_edges`` and ``block_keys``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import as_bytes, components, cut, fresh, slices, spans, stored, word_blocks

SEED = 42
N_PIVOTS = 16
#: Reference fingerprints, from a fixed rule.
PIVOTS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (4, N_PIVOTS), dtype=np.uint64, endpoint=False)
#: Bits of each block of a 64-bit fingerprint; a key is two blocks. Within radius 4 two of six blocks agree.
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 4
#: Largest run that is compared in one task.
CAP = 4096
#: Runs up to this size are compared by shifted arrays.
SMALL = 32
#: For near_duplicates(): words of a shingle, least Jaccard similarity, 64-bit words of a fingerprint.
SHINGLE, SIMILARITY, WORDS = 5, 0.8, 4
#: Largest share of differing bits expected of two sets with a similarity of 0.8: four shingles and one more, as 3 of 16 pairs of sums straddle the half.
LARGEST_SHARE = 3 / 16
#: Nodes of a group, and bytes of their sets, that are compared in one part.
PART, PART_BYTES = 512, 32 << 20
#: Keys of a text, and least hashes that make one; at a similarity of 0.8 all keys differ once in 3,000 pairs.
BANDS, ROWS = 20, 5


def safe_radius(bits: int, share: float, risk: float) -> int:
    """The least radius that so many bits, each differing with that probability, exceed with at most that risk."""
    tail = 0.0
    for k in range(bits, 0, -1):
        tail += math.comb(bits, k) * share**k * (1 - share) ** (bits - k)
        if tail > risk:
            return k
    return 0


#: Differing bits of 256 that a pair may have: a similar pair exceeds them once in 10^9.
WIDE_RADIUS = safe_radius(64 * WORDS, LARGEST_SHARE, 1e-9)
_MIX = np.random.Generator(np.random.PCG64(SEED + 1)).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---- fingerprints -------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 of each k-word shingle of the lower-cased text, repeats included, in blocks."""
    digest, first = xxhash.xxh64_intdigest, True
    for words in word_blocks(text, carry=k - 1):
        if len(words) < k:
            if first:
                yield np.array([digest(b" ".join(words).lower(), SEED)], dtype=np.uint64)
            continue
        first = False
        joined = b" ".join(words).lower()
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        end = (begin + size)[k - 1 :].tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(begin.tolist(), end, strict=False)], dtype=np.uint64)


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64-bit hash from h; word 0 is h itself."""
    if word == 0:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    total = bits[full:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    if full:
        total += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, k: int = 4, words: int = 1) -> np.ndarray:
    """words 64-bit words; all zero for a text that is null or has no word."""
    sums, n = np.zeros((words, 64), np.int64), 0
    for h in shingle_hashes(text, k):
        n += len(h)
        for w in range(words):
            sums[w] += bit_sums(mixed(h, w))
    return np.packbits(2 * sums > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int = 4, words: int = 1) -> DataFrame:
    """(id, fp): fp is a long, or an array of them where words > 1. Other columns are ignored."""
    kind = "long" if words == 1 else "array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, k, words).view(np.int64) for t in as_bytes(batch.column(1))]
            out = pa.array([x[0] for x in fp], pa.int64()) if words == 1 else pa.array(fp, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp {kind}")


# ---- comparing ----------------------------------------------------------------------------


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows of up to four 64-bit words) to each pivot."""
    return sum(np.bitwise_count(fp[:, w : w + 1] ^ PIVOTS[w][None, :]).astype(np.int16) for w in range(fp.shape[1]))


def with_pivots(distinct: DataFrame) -> DataFrame:
    """(fp, c0, c1): distinct 64-bit fingerprints with their distances to the pivots, a byte each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(np.asarray(batch.column(0)).view(np.uint64)[:, None])
            held = np.ascontiguousarray(table, dtype=np.uint8).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held[:, 0]), pa.array(held[:, 1])], ["fp", "c0", "c1"])

    return distinct.select("fp").mapInArrow(run, "fp long, c0 long, c1 long")


def far_by_pivots(c: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no pivot rules out."""
    for p in range(c.shape[1]):
        near = np.abs(c[i, p] - c[j, p]) <= radius
        i, j = i[near], j[near]
    return i, j


def distance(fp: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]).sum(axis=-1, dtype=np.int64)


def forest(fp: np.ndarray, c: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest of the pairs within the radius (Prim)."""
    n = len(fp)
    best, by = np.full(n, 1 << 30), np.zeros(n, np.int64)
    out = np.ones(n, bool)
    at, a, b = 0, [], []
    for _ in range(n - 1):
        out[at] = False
        rest = np.flatnonzero(out)
        _, near = far_by_pivots(c, np.full(len(rest), at), rest, radius)
        d = distance(fp, near, at)
        closer = (d < best[near]) & (d <= radius)
        best[near[closer]], by[near[closer]] = d[closer], at
        at = int(rest[np.argmin(best[rest])])
        if best[at] <= radius:
            a.append(at)
            b.append(by[at])
    return np.array(a, np.int64), np.array(b, np.int64)


def run_edges(group: np.ndarray, fp: np.ndarray, c: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join what links within each run of equal, sorted group numbers; c: distances to the pivots."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(group)])
    a, b = [], []
    small = np.repeat(size <= SMALL, size)
    i, shift = np.flatnonzero(small), 1
    while len(i):
        i = i[i + shift < len(group)]
        i = i[group[i] == group[i + shift]]
        x, y = far_by_pivots(c, i, i + shift, radius)
        near = distance(fp, x, y) <= radius
        a.append(x[near])
        b.append(y[near])
        shift += 1
    for s, n in zip(starts[size > SMALL], size[size > SMALL], strict=True):
        x, y = forest(fp[s : s + n], c[s : s + n], radius)
        a.append(x + s)
        b.append(y + s)
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def whole_runs(batches: Iterable[pa.RecordBatch], words: int, before: int) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first, in parts that end at the end of a run of equal values.

    The columns from number before on, words of them, come as one array.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [np.asarray(x) for x in batch.columns]
        now = [*now[:before], np.stack(now[before : before + words], axis=1).view(np.uint64)]
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        if len(held[0]):
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield [x[:last] for x in held]
                held = [x[last:] for x in held]
    if held and len(held[0]):
        yield held


def linked_runs(radius: int):
    """For mapInArrow: rows (g, id, fp, c0, c1) sorted by g; gives edges (a, b) between ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, ids, held in whole_runs(batches, 3, 2):
            c = np.ascontiguousarray(held[:, 1:]).view(np.uint8).astype(np.int16)
            i, j = run_edges(g, held[:, :1], c, radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    return run


def block_masks(blocks: tuple[int, ...] = BLOCKS, keep: int = 2) -> list[int]:
    at, spans = 0, []
    for size in blocks:
        spans.append(((1 << size) - 1) << at)
        at += size
    return [sum(c) for c in combinations(spans, keep)]


def ball_edges(hot: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """Edges for fingerprints of crowded keys, without comparing pairs.

    Two fingerprints with equal key bits and a distance of up to twice r share a point within r of
    both. Each is sent to all points within r = radius / 2 among the bits outside the key. Those
    that meet at a point are within 2 r of each other, and there are no more than the points of
    such a ball (904 for two blocks of 64 bits), so that one edge each to the smallest will do.
    """
    r = radius // 2
    flips = []
    for mask in masks:
        free = [1 << b for b in range(64) if not mask >> b & 1]
        flips.append(np.array([sum(x) for n in range(r + 1) for x in combinations(free, n)], dtype=np.uint64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, fp in zip(batch.column(0).to_pylist(), np.asarray(batch.column(1)).view(np.uint64), strict=True):
                points = (flips[t] ^ fp).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), t, np.int32)), pa.array(points), pa.array(np.full(len(points), fp.view(np.int64)))],
                    ["t", "point", "fp"],
                )

    met = hot.select("t", "fp").mapInArrow(run, "t int, point long, fp long")
    met = met.groupBy("t", "point").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    edges = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
    return edges.where("a <> b").distinct()


def fingerprint_edges(distinct: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS, cap: int = CAP) -> DataFrame:
    """Edges (a, b) that connect whatever is connected by pairs of fp within the radius, exactly.

    blocks must number radius + 2, so that two of them agree in any such pair.
    """
    if len(blocks) < radius + 2 or sum(blocks) != 64:
        raise ValueError("blocks must cover 64 bits and number radius + 2 at least")
    masks = block_masks(blocks)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(np.uint64(m).view(np.int64).item())).alias("key")) for t, m in enumerate(masks)])
    keyed = cut(with_pivots(distinct)).select("fp", "c0", "c1", F.explode(keys).alias("k")).select("k.t", "k.key", "fp", "c0", "c1")
    crowded = cut(keyed.groupBy("t", "key").count().where(F.col("count") > cap).select("t", "key"))
    calm, hot_edges = keyed, None
    if crowded.head(1):
        calm = keyed.join(crowded, ["t", "key"], "left_anti")
        hot_edges = ball_edges(keyed.join(crowded, ["t", "key"], "left_semi"), radius, masks)
    # the key bits of table t are all in key, so that t and key in one number can stay apart: sort by both, number by hash
    runs = calm.select(F.xxhash64("t", "key").alias("g"), F.col("fp").alias("id"), "fp", "c0", "c1")
    runs = runs.repartition(F.col("g")).sortWithinPartitions("g", "id")
    edges = runs.mapInArrow(linked_runs(radius), "a long, b long")
    return edges.union(hot_edges) if hot_edges is not None else edges


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    fingerprint: 16 hex digits. component_id: the smallest id reachable over fingerprints that
    differ in at most radius bits, its own included. Equal fingerprints are one node, so copies
    cost one row each. A null or wordless text has fingerprint zero, linked like any other. A row
    with a null id keeps its fingerprint and gets the component's smallest id, null where there is
    none. Repeated ids each keep their row. Columns beside the two named are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, k))
    reps = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    linked = components(fingerprint_edges(reps.select("fp"), radius, cap=cap))
    named = cut(reps.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    known = cut(named.join(least, "component").select("fp", "component_id"))
    return prints.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near duplicates by similarity ---------------------------------------------------------


def shingles(text: bytes | None) -> np.ndarray:
    """The different shingle hashes of a whole text, sorted."""
    found = np.zeros(0, np.uint64)
    for h in shingle_hashes(text, SHINGLE):
        found = np.unique(np.concatenate([found, h]))
    return found


def signature(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(fingerprint of WORDS words, BANDS keys, different shingles); the keys are hashes of the least of ROWS hashes each.

    Both come from the set of the text's shingles, so that lines repeated often weigh no more than others.
    """
    held = shingles(text)
    sums = np.stack([bit_sums(mixed(held, w)) for w in range(WORDS)])
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(held), 2048):
        x = held[i : i + 2048, None] * _MIX[0] + _MIX[1]
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0))
    keys = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mixed(out ^ keys[:, r], r + 1)
    return np.packbits(2 * sums > len(held), axis=1, bitorder="little").view(np.uint64)[:, 0], out, len(held)


def similar_forest(fp: np.ndarray, held: list[np.ndarray], comp: np.ndarray, similarity: float, radius: int) -> tuple[list[int], list[int]]:
    """Index pairs of sets of that Jaccard similarity; with what comp has joined they connect all that such pairs connect.

    A search from each set in turn through the sets that nothing has reached yet; set sizes, pivots
    and bits discard, the elements in common decide.
    """
    n = len(held)
    size = np.fromiter(map(len, held), np.int64, n)
    values, flat = np.unique(np.concatenate(held), return_inverse=True)
    end = np.cumsum(size)
    own = [flat[e - k : e] for e, k in zip(end.tolist(), size.tolist(), strict=True)]
    label = np.unique(comp, return_inverse=True)[1]
    mates = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
    c, mark, least = pivot_table(fp), np.zeros(len(values), np.uint8), similarity - 1e-9
    left, starts = np.arange(n), end - size
    fresh_, seen = len(left), np.zeros(n, bool)
    a: list[int] = []
    b: list[int] = []
    for seed in range(n):
        if seen[seed]:
            continue
        queue = mates[label[seed]].tolist()
        seen[queue] = True
        while queue:
            i = queue.pop()
            rest = left[~seen[left]]
            if not len(rest):
                return a, b
            near = rest[(size[rest] >= least * size[i]) & (size[i] >= least * size[rest])]
            _, near = far_by_pivots(c, np.full(len(near), i), near, radius)
            near = near[distance(fp, near, i) <= radius]
            if not len(near):
                continue
            if 2 * len(rest) < fresh_:  # what is left stands side by side
                left, fresh_ = rest, len(rest)
                flat = np.concatenate([own[k] for k in rest.tolist()])
                starts = np.cumsum(size[rest]) - size[rest]
            mark[own[i]] = 1
            if len(near) * 8 < len(left):
                both = np.fromiter((mark[own[k]].sum(dtype=np.int64) for k in near.tolist()), np.int64, len(near))
            else:
                both = np.add.reduceat(mark[flat], starts, dtype=np.int64)[np.searchsorted(left, near)]
            mark[own[i]] = 0
            for j in near[both >= similarity * (size[i] + size[near] - both)].tolist():
                if not seen[j]:
                    a.append(i)
                    b.append(j)
                    queue += mates[label[j]].tolist()
                    seen[mates[label[j]]] = True
    return a, b


def by_group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of each value of the first column, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        g = np.asarray(batch.column(0))
        for s, e in spans(g):
            if held and g[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = g[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def shingle_sets(texts: DataFrame, nodes: DataFrame, spots: DataFrame) -> DataFrame:
    """(node, held, f0..., spots): the sorted shingle hashes, as bytes, of each node that has spots, from (node, text)."""
    prints = [F.get("fp", F.lit(w)).alias(f"f{w}") for w in range(WORDS)]
    names = [f"f{w}" for w in range(WORDS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            held = pa.array([shingles(t).tobytes() for t in as_bytes(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, *batch.columns[2:]], ["node", "held", *names, "spots"])

    # a node has a spot for each of its keys at most
    at = spots.groupBy("node").agg(F.collect_list(F.struct("g", "comp", "own", "low", "high")).alias("spots"))
    rows = texts.join(at.join(nodes.select("node", *prints), "node"), "node").select("node", "text", *names, "spots")
    return rows.mapInArrow(run, "node long, held binary, " + "".join(f"{n} long, " for n in names) + f"spots {dict(at.dtypes)['spots']}")


def compared(spots: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) that join, over comp, what pairs within a part connect.

    spots: (node, g, comp, own, low, high): the node is in the parts {own, x} of group g, x from low
    to high. The sets are made from the texts on the way to the parts and held nowhere.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches):
            node, comp = (t.column(k).to_numpy() for k in ("node", "comp"))
            fp = np.stack([t.column(f"f{w}").to_numpy() for w in range(WORDS)], axis=1).view(np.uint64)
            a, b = similar_forest(fp, [np.frombuffer(x, np.uint64) for x in t.column("held").to_pylist()], comp, similarity, radius)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    names = ["held", *(f"f{w}" for w in range(WORDS))]
    rows = shingle_sets(texts, nodes, spots).select("node", *names, F.inline("spots"))
    rows = rows.select("node", "comp", *names, "g", "own", F.explode(F.sequence("low", "high")).alias("other"))
    rows = rows.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "comp", *names)
    return rows.repartition(F.col("g")).sortWithinPartitions("g", "node").mapInArrow(run, "a long, b long")


def key_groups(nodes: DataFrame, cap: int) -> DataFrame:
    """(g, node, n, per, leader) for (node, keys, size): the n nodes with a common key, in parts of up to per nodes.

    Keys with the same nodes give one group. leader: the smallest node. per is cap, or less where sets are large.
    """
    keyed = nodes.where("size > 0").select(F.explode("keys").alias("g"), "node", "size")
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    groups = keyed.groupBy("g").agg(F.count("*").alias("n"), *same, F.sum(F.col("size").cast("long")).alias("total"), F.min("node").alias("leader")).where("n > 1")
    once = groups.groupBy("n", "x0", "x1").agg(F.min("g").alias("g"), F.first("total").alias("total"), F.first("leader").alias("leader"))
    per = F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.lit(PART_BYTES / 8) * F.col("n") / F.col("total"))))
    return keyed.select("g", "node").join(once.select("g", "n", per.alias("per"), "leader"), "g")


def similar_links(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, cap: int = PART) -> DataFrame:
    """Links (a, b) of similar texts that connect all that pairs with a common key connect.

    A group of more than cap nodes is cut into parts, each compared with the group's leader among
    it. Mostly that joins nearly all; what then isn't in the group's largest component is compared
    with the whole group, part by part. So no link is lost, and a group is compared with itself as
    a whole only where it stays apart. No pairs leave a task but the edges of its forest.
    """
    members = stored(key_groups(nodes, cap), "members")
    dealt = members.withColumn("parts", F.ceil(F.col("n") / F.col("per")).cast("int"))
    place, leads = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"), F.col("node") == F.col("leader")
    first = dealt.select("node", "g", F.col("node").alias("comp"), F.lit(0).alias("own"), F.when(leads, 0).otherwise(place).alias("low"), F.when(leads, F.col("parts") - 1).otherwise(place).alias("high"))
    links = cut(compared(first, texts, nodes, similarity, radius))
    large = dealt.where("parts > 1")
    if large.head(1):
        large = cut(large.join(components(links), "node", "left").select("g", "node", "per", F.coalesce("component", "node").alias("comp")))
        sizes = large.groupBy("g", "comp").agg(F.count("*").alias("n")).groupBy("g")
        sizes = sizes.agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"))
        sizes = sizes.select("g", F.col("most.comp").alias("main"), F.col("most.n").alias("joined"), (F.col("n") - F.col("most.n")).alias("apart")).where("apart > 0")
        large = large.join(sizes, "g").withColumn("loose", F.col("comp") != F.col("main"))
        blocks = {k: F.ceil(F.col(k) / F.col("per")).cast("int") for k in ("joined", "apart")}
        h = F.xxhash64("node", F.lit(4))
        # blocks of what is apart are numbered from 0, those of the main component from -1 down
        large = large.withColumn("own", F.when(F.col("loose"), F.pmod(h, blocks["apart"])).otherwise(-1 - F.pmod(h, blocks["joined"])).cast("int"))
        low = F.when(F.col("loose"), -blocks["joined"]).otherwise(F.lit(0))
        again = large.select("node", "g", "comp", "own", low.alias("low"), (blocks["apart"] - 1).alias("high"))
        links = cut(links.union(compared(again, texts, nodes, similarity, radius)))
    return links


def near_duplicates(docs: DataFrame, row_col: str, text_col: str = "text", similarity: float = SIMILARITY, cap: int = PART) -> DataFrame:
    """(row_col, component) for every row of docs: rows with the same component are near duplicates.

    Texts link where their sets of five-word shingles (lower-cased; fewer words: the whole
    sequence) have a Jaccard similarity of 0.8 or more. Fingerprints of 256 bits stand for the
    texts; texts that have them and all keys equal are one node. Bits alone would need too many
    keys at this similarity, so pairs are formed by keys of least shingle hashes; the pivot table
    and the bits discard, and the shingles of the two texts decide. row_col must be unique. Texts that are
    null or without a word are one another's duplicates.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t) for t in as_bytes(batch.column(1))]
            fp, keys = (pa.array([x[k].view(np.int64) for x in found], pa.list_(pa.int64())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, keys, pa.array([x[2] for x in found], pa.int32())], ["row", "fp", "keys", "size"])

    rows = docs.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    signed = stored(rows.mapInArrow(run, f"row {dict(rows.dtypes)['row']}, fp array<long>, keys array<long>, size int"), "signatures")
    nodes = stored(signed.groupBy("fp", "keys").agg(F.min("row").alias("node"), F.max("size").alias("size")), "nodes")
    texts = rows.select(F.col("row").alias("node"), "text")
    linked = components(similar_links(nodes, texts, similarity, cap=cap))
    named = nodes.join(linked, "node", "left").select("fp", "keys", F.coalesce("component", "node").alias("component"))
    return signed.join(named, ["fp", "keys"]).select(F.col("row").alias(row_col), "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, cap: int = PART) -> DataFrame:
    """The rows of docs, all columns, with one row of each group of near duplicates.

    That with the smallest id stays, one with a null id only if there is no other; of repeated
    rows one stays.
    """
    row = fresh(docs, "row")
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(held, row, text_col, similarity, cap).join(held.select(row, F.col(id_col).alias("id_")), row)
    first = F.min(F.struct(F.col("id_").isNull().alias("none"), F.col("id_").alias("id"), F.col(row).alias("row")))
    kept = groups.groupBy("component").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return held.join(cut(kept), row, "left_semi").select(docs.columns)
