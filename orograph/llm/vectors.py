"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the vectors again and again at the median of a random projection; vectors near
a split go to both sides, so that close vectors seldom part. Vectors are compared only within the
leaves, over many trees, by exact cosine; the links found are united to components.

Equal vectors are one node, so that copies cost nothing. A leaf gives the number of links of each
of its vectors and the edges of a forest, never its pairs. A pair that meets in several leaves
counts in the first of them alone, as each vector carries the codes of all its leaves; so the
counts add up. A leaf with more vectors than ``cap`` is cut into blocks, and every two blocks are
compared in a task of their own: no link is lost and no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import components, cut, spans, stored, within_share

SEED = 42
#: Vectors of a leaf, about.
LEAF = 768
#: How far on both sides of a split vectors go to both, in deviations of a unit vector's projection, which are 1 / sqrt(width).
SPILL = 0.12
#: Share of the pairs at the threshold that the trees are to find, if vectors lie evenly.
RECALL = 0.9995
MOST_TREES = 48
#: Vectors that the splits are fitted on, at most about.
SAMPLE = 16_384
#: Largest leaf that is compared in one piece.
CAP = 4096
THRESHOLD = 0.93
#: A leaf's code is its tree and its number, of so many bits.
LEAF_BITS = 40


def trees_needed(depth: int, width: int, threshold: float = THRESHOLD, spill: float = SPILL, recall: float = RECALL) -> int:
    """Trees of a depth that lose no more than 1 - recall of the pairs at the threshold.

    A projection of unit vectors is nearly normal with a deviation of 1 / sqrt(width). A split parts
    a pair whose difference there exceeds twice the spill, once for each density at the median.
    """
    if depth == 0:
        return 1
    spill /= math.sqrt(width)
    s = math.sqrt(max(1e-12, 2 - 2 * threshold) / width)
    z = 2 * spill / s
    tail = 2 * (s * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 2 * spill * math.erfc(z / math.sqrt(2)) / 2)
    kept = max(0.05, 1 - tail * math.sqrt(width / (2 * math.pi))) ** depth
    return min(MOST_TREES, max(2, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - kept)))))


@dataclass(frozen=True)
class Forest:
    """directions[tree, level]; medians[tree][level]: a threshold for each node of the level, by its number."""

    directions: np.ndarray
    medians: tuple[tuple[np.ndarray, ...], ...]

    def leaves(self, x: np.ndarray, tree: int, spill: float, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that each row of unit vectors falls in, at the depth of each row."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level, median in enumerate(self.medians[tree]):
            on = deep[row] > level
            at = (x @ self.directions[tree, level])[row] - median[np.minimum(node, len(median) - 1)]
            left, right = on & (at <= spill), on & (at >= -spill)
            row = np.concatenate([row[~on], row[left], row[right]])
            node = np.concatenate([node[~on], 2 * node[left], 2 * node[right] + 1])
        return row, node


def fit(sample: np.ndarray, depth: int, trees: int, seed: int = SEED) -> Forest:
    """Random directions, split at the sample's medians; nodes without sample rows split at zero."""
    rng = np.random.Generator(np.random.PCG64(seed))
    d = sample.shape[1]
    directions = rng.standard_normal((trees, max(depth, 1), d))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    out = []
    for t in range(trees):
        node, medians = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            at = sample @ directions[t, level]
            # a level's table is as long as the nodes that the sample reaches, and one for all others
            median = np.zeros(min(1 << level, 4 * len(sample)) + 1)
            order = np.lexsort((at, node))
            for a, b in spans(node[order]):
                if node[order[a]] < len(median) - 1 and b - a >= 2:
                    median[node[order[a]]] = np.median(at[order[a:b]])
            medians.append(median)
            node = 2 * node + (at > median[np.minimum(node, len(median) - 1)])
        out.append(tuple(medians))
    return Forest(directions, tuple(out))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # by the largest component first, so that very large and very small vectors keep their direction
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(rows: DataFrame) -> DataFrame:
    """rows (id, label, vec) with node: a number of the label and the vector, null where it can't link; unit: its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for v in batch.column(2).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
                good = len(x) and np.isfinite(x).all() and x.any()
                out.append((_unit(x[None, :])[0] + 0.0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "unit"])

    kind = dict(rows.dtypes)
    made = rows.mapInArrow(run, f"id {kind['id']}, label {kind['label']}, unit binary")
    node = F.when(F.col("unit").isNotNull() & F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"), "unit"))
    return made.withColumn("node", node)


def _met(codes: list[np.ndarray], code: int) -> np.ndarray:
    """A row for each vector: 1 at each of its leaves before that of the code, of those that another vector here shares."""
    size = np.fromiter(map(len, codes), np.int64, len(codes))
    flat, owner = np.concatenate(codes), np.repeat(np.arange(len(codes)), size)
    before = flat < code
    seen, at, n = np.unique(flat[before], return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    out = np.zeros((len(codes), int((n > 1).sum())), np.float32)
    shared = n[at] > 1
    out[owner[before][shared], place[at][shared]] = 1
    return out


def linked(unit: np.ndarray, met: np.ndarray, threshold: float, split: int | None, step: int = 1024) -> np.ndarray:
    """Which vectors link that haven't met before; split: only those with one before it and one from it on."""
    n = len(unit)
    out = np.zeros((n, n), bool)
    for a in range(0, n if split is None else split, step):
        left = slice(a, min(a + step, n if split is None else split))
        for b in range(a if split is None else split, n, step):
            right = slice(b, b + step)
            hit = unit[left] @ unit[right].T >= threshold
            if hit.any():
                if met.shape[1]:
                    hit &= met[left] @ met[right].T == 0
                out[left, right] = hit
                out[right, left] = hit.T
    out[np.arange(n), np.arange(n)] = False
    return out


def forest_of(adjacent: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest."""
    fresh, a, b = np.ones(len(adjacent), bool), [], []
    for seed in np.flatnonzero(adjacent.any(axis=1)).tolist():
        queue = [seed] if fresh[seed] else []
        fresh[seed] = False
        while queue:
            i = queue.pop()
            found = np.flatnonzero(adjacent[i] & fresh).tolist()
            fresh[found] = False
            queue += found
            a += [i] * len(found)
            b += found
    return a, b


def _compare(threshold: float, crossed: bool):
    """For mapInArrow: rows (g, side, node, unit, copies, code, codes) sorted by g and side; gives (a, b, n).

    n is the number of rows that a links with here, b null; or b is a's neighbour in the forest, n null.
    """

    def found(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        _, side, node, unit, copies, code, codes = rows
        unit = np.frombuffer(b"".join(unit), np.float64).reshape(len(node), -1)
        met = _met([np.frombuffer(x, np.int64) for x in codes], int(code[0]))
        hit = linked(unit, met, threshold, int((side == 0).sum()) if crossed else None)
        own = np.flatnonzero(hit.any(axis=1))
        if len(own):
            a, b = forest_of(hit)
            n = hit[own] @ copies
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[own], node[a]])), pa.array([None] * len(own) + node[b].tolist(), pa.int64()), pa.array(n.tolist() + [None] * len(a), pa.int64())],
                ["a", "b", "n"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            # dims differ between groups: the bytes stay until a group is whole
            now = tuple(np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else np.asarray(c) for c in batch.columns)
            held = tuple(np.concatenate(x) for x in zip(held, now, strict=True)) if held else now
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield from groups(tuple(x[:last] for x in held))
            held = tuple(x[last:] for x in held)
        if held:
            yield from groups(held)

    def groups(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for a, b in spans(rows[0]):
            if b - a > 1:
                yield from found(tuple(x[a:b] for x in rows))

    return run


def links(nodes: DataFrame, threshold: float = THRESHOLD, trees: int | None = None, leaf: int = LEAF, spill: float = SPILL, cap: int = CAP, sample: int = SAMPLE) -> DataFrame:
    """(a, b, n) from distinct (node, label, unit, copies): see _compare(); n of one node add up to all its links.

    Labels are split as deep as their own count asks for. trees: as many as RECALL asks for at that
    depth, if not given.
    """
    spark = nodes.sparkSession
    sizes = nodes.groupBy("label", F.length("unit").alias("width")).agg(F.count("*").alias("n"))
    sizes = cut(sizes.withColumn("deep", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / float(leaf)))).cast("int")))
    out = None
    for r in sizes.groupBy("width").agg(F.sum("n").alias("n"), F.max("deep").alias("deep")).orderBy("width").toLocalIterator():  # vectors of different length never link
        width, n, depth = r["width"], r["n"], r["deep"]
        needed = np.array([trees or trees_needed(d, width // 8, threshold, spill) for d in range(depth + 1)])
        reach = spill / math.sqrt(width // 8)
        own = nodes.where(F.length("unit") == width).join(sizes.where(F.col("width") == width).select("label", "deep"), "label")
        some = own.where(within_share(F.xxhash64("node"), min(1.0, sample / n))).select("unit")
        units = [bytes(x["unit"]) for x in some.collect()]  # about as many as the sample, by the hash
        points = np.frombuffer(b"".join(sorted(units)), np.float64).reshape(-1, width // 8)
        shared = spark.sparkContext.broadcast(fit(points, depth, int(needed.max())))

        def place(batches: Iterable[pa.RecordBatch], shared=shared, needed=needed, reach=reach) -> Iterator[pa.RecordBatch]:
            forest = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                x, deep = _matrix(batch.column(2)), np.asarray(batch.column(4))
                row, code = [], []
                for t in range(len(forest.medians)):
                    some = np.flatnonzero(needed[deep] > t)
                    if len(some):
                        i, at = forest.leaves(x[some], t, reach, deep[some])
                        row.append(some[i])
                        code.append(at + (t << LEAF_BITS))
                row, code = np.concatenate(row), np.concatenate(code)
                order = np.lexsort((code, row))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(ends), pa.array(code[order]))
                binary = pa.array([code[order][a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], codes, binary], ["node", "label", "unit", "copies", "leaf", "codes"])

        kind = f"node long, label {dict(nodes.dtypes)['label']}, unit binary, copies long, leaf array<long>, codes binary"
        placed = stored(own.select("node", "label", "unit", "copies", "deep").mapInArrow(place, kind), "leaves")
        g = F.xxhash64(F.col("label").cast("string"), "code").alias("g")
        crowded = cut(placed.select("label", F.explode("leaf").alias("code")).groupBy(g).agg(F.count("*").alias("n")).where(F.col("n") > cap))
        rows = placed.select("node", "label", "unit", "copies", F.explode("leaf").alias("code"), "codes").select(g, "node", "unit", "copies", "code", "codes")
        calm, parts = rows, []
        if crowded.head(1):
            calm = rows.join(crowded, "g", "left_anti")
            hot = rows.join(crowded, "g").withColumn("blocks", F.ceil(F.col("n") / (cap // 2)).cast("int"))
            hot = hot.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
            hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            side = F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side")
            block = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g")
            for same in (True, False):
                part = hot.where((F.col("own") == F.col("other")) == same).select(block, side, "node", "unit", "copies", "code", "codes")
                parts.append((part, not same))
        parts.append((calm.select("g", F.lit(0).alias("side"), "node", "unit", "copies", "code", "codes"), False))
        for part, crossed in parts:
            part = part.repartition(F.col("g")).sortWithinPartitions("g", "side")
            part = part.mapInArrow(_compare(threshold, crossed), "a long, b long, n long")
            out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "a long, b long, n long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Two rows link where their labels are equal and not null and the cosine of their vectors, in
    double precision, is threshold at least. Vectors that are null, empty, zero or hold null or
    non-finite components, and those of another length, link with nothing. n_links: other rows
    linked directly. component_id: the smallest id reachable by links, the row's own included.
    kept: whether that is the row's own id. Every repeated row counts as a row of its own; rows
    with a null id link like any other, and have a null component_id only if no linked row has
    an id. Columns beside those named are ignored. options: see links().
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = stored(nodes_of(rows), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("id").alias("least"))
    nodes = cut(nodes)
    found = cut(links(nodes.select("node", "label", "unit", "copies"), threshold, **options))
    others = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = nodes.join(components(found.where("b is not null").select("a", "b")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named.select("node", "component", "copies", "least"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").join(others, "node", "left")
    known = cut(known.select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
