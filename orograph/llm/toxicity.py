"""Toxicity by maximum-scoring segments of token log-odds.

Each token has a score: the log-odds of toxic over clean text under Dirichlet priors, less a
drift that makes clean text lose score. A token's prior is the rate of its stem (its first
letters), whose own prior is the rate of all text, so that an unseen form of a known stem counts.
One pass over a text finds every maximal scoring segment (Ruzzo and Tompa). The best segment of
clean text follows an extreme-value law (Karlin and Altschul); it turns a segment's score into
bits above what a clean text of the same length would give, and those bits into a probability.

Tokens are counted and the calibration's texts are scored in the tasks; the driver gets the
significant tokens, the counts of scores, and two numbers for each of the calibration's rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import as_bytes, cut, stored, text_blocks, within_share

#: Letters of a stem; a shorter word is its own.
STEM = 5
#: What each token costs, in nats.
DRIFT = 0.5
#: Tokens whose log-odds are nearer to zero than this many standard errors count as unknown.
LEAST_Z = 2.0
#: Pseudo-counts of the prior of a stem and of a token.
PRIOR_STEM, PRIOR_TOKEN = 2.0, 4.0
#: Largest log-odds.
MOST = 8.0
#: Labelled rows of each class that are learned from, at most, and the parts that calibrate each other.
ROWS_PER_CLASS, PARTS = 20_000, 3
#: Tokens, and stems, that the model holds: those with the largest log-odds.
VOCABULARY = 200_000
#: Different tokens that a task counts before it passes them on.
HELD = 500_000
#: Segments with more than one clean text in so many expected above their score aren't significant.
SIGNIFICANT = 0.01
THRESHOLD = 0.3
EULER = 0.5772156649015329

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Scores of tokens and stems, lambda and K of the extreme-value law, weights of the calibration."""

    tokens: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)


class Scores(dict):
    """Scores of tokens, filled in from the stems as tokens come up."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.tokens)
        self.stems = model.stems

    def __missing__(self, token: str) -> float:
        found = self.stems.get(token[:STEM], 0.0) if len(token) > STEM else 0.0
        if len(self) > 1_000_000:
            return found
        self[token] = found
        return found


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, one past the last, score) of every maximal scoring segment, in linear time.

    Only tokens with a positive score begin or end a segment, so that the scan visits these and
    takes the sums between them from the running total.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # total before, total at the end, first, end, place of the nearest earlier segment that begins lower
    out: list[tuple[float, float, int, int, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, first = float(total[i]), float(total[i + 1]), i
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= left:
                j = out[j][4]
            if j < 0 or out[j][1] >= right:
                break
            left, first, before = out[j][0], out[j][2], out[j][4]
            del out[j:]
            j = before
        out.append((left, right, first, i + 1, j))
    return [(a, b, right - left) for left, right, a, b, _ in out]


def token_scores(text: str | None, scores: Scores) -> np.ndarray:
    """Score of each token of a whole text, drift taken off."""
    parts = [np.fromiter(map(scores.__getitem__, tokens(t)), np.float64) for t in text_blocks(text)]
    return (np.concatenate(parts) if parts else np.zeros(0)) - DRIFT


def found_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    return segments(s) if len(s) and s.max() > 0 else []


def excess(score: float, n: int, model: Model) -> float:
    """Nats by which a segment's score is above that expected of a clean text of n tokens."""
    return model.lam * score - math.log(model.k * max(n, 1))


def weighed(scores: list[float], n: int, model: Model) -> tuple[float, float]:
    """(excess of the best segment, excess of all significant others) from the segment scores of a text of n tokens."""
    if not scores:
        return -10.0, 0.0
    over = sorted((excess(x, n, model) for x in scores), reverse=True)
    return over[0], sum(x for x in over[1:] if x >= -math.log(SIGNIFICANT))


def evidence(text: str | None, scores: Scores, model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """(excess of the best segment, excess of all significant others, the significant segments)."""
    s = token_scores(text, scores)
    found = found_segments(s)
    kept = [x for x in found if excess(x[2], len(s), model) >= -math.log(SIGNIFICANT)]
    return *weighed([x[2] for x in found], len(s), model), kept


def features(best: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.clip(best, -10, 40), np.log1p(np.maximum(rest, 0))], axis=1)


def probability(best: np.ndarray, rest: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(best, rest) @ np.array(model.weights), -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; slopes are never negative."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate([w[:1], np.maximum(w[1:], 0)])


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, t, c): how often each token occurs in rows (text, y) with y = 1 and y = 0, counted in each task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[y][w] for w in names], pa.int64()) for y in (1, 0))], ["token", "t", "c"])

        for batch in batches:
            for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for part in text_blocks(text.decode("utf-8", "replace")):
                    counts[y].update(tokens(part))
                if sum(map(len, counts)) > HELD:
                    yield out()
                    for c in counts:
                        c.clear()
        yield out()

    return rows.select("text", "y").mapInArrow(run, "token string, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def log_odds(counts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Significant log-odds of tokens, and of stems, from token_counts(); tokens without any of their own, but with a stem that has, are 0."""
    counts = cut(counts)
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not total["t"] or not total["c"]:
        return {}, {}
    base = total["t"] / (total["t"] + total["c"])

    def shrunk(t, c, rate, strength: float) -> tuple[F.Column, F.Column, F.Column]:
        a, b = t + rate * strength, c + (1 - rate) * strength
        odds = F.log(a / float(total["t"])) - F.log(b / float(total["c"]))
        return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), odds)), F.abs(odds) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), a / (a + b)

    stem = F.substring("token", 1, STEM).alias("stem")
    odds, z, rate = shrunk(F.col("t"), F.col("c"), F.lit(base), PRIOR_STEM)
    stems = cut(counts.groupBy(stem).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).select("stem", odds.alias("stem_odds"), z.alias("stem_z"), rate.alias("rate")))
    odds, z, _ = shrunk(F.col("t"), F.col("c"), F.col("rate"), PRIOR_TOKEN)
    known = counts.withColumn("stem", stem).join(stems, "stem").select("token", odds.alias("odds"), (z >= LEAST_Z).alias("own"), (F.col("stem_z") >= LEAST_Z).alias("of_stem"))
    known = cut(known.where("own or of_stem"))

    def largest(df: DataFrame, name: str, value: str) -> dict[str, float]:
        rows = df.select(name, value).orderBy(F.desc(F.abs(value)), name).limit(VOCABULARY).toArrow()
        return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))

    own = largest(known.where("own"), "token", "odds")
    neutral = known.where("not own").select("token").orderBy("token").limit(VOCABULARY).toArrow().column(0).to_pylist()
    return own | dict.fromkeys(neutral, 0.0), largest(stems.where((F.col("stem_z") >= LEAST_Z) & (F.length("stem") == STEM)), "stem", "stem_odds")


def extreme_values(scores: np.ndarray, counts: np.ndarray, best: list[tuple[float, int]]) -> tuple[float, float]:
    """(lambda, K): sum p e^(lambda s) = 1 over the counted scores of clean tokens; K from the (best segment's score, tokens) of clean texts."""
    if not len(scores) or scores.max() <= 0:
        return 1.0, 0.1
    p = counts / counts.sum()
    if (p * scores).sum() >= 0:
        return 0.1, 0.1
    low, high = 0.0, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    lam = max(low, 1e-3)
    k = math.exp(np.mean([lam * m - math.log(n) for m, n in best]) - EULER) if best else 0.1
    return lam, min(max(k, 1e-6), 10.0)


def told_by(rows: DataFrame, model: Model) -> DataFrame:
    """(y, n, found, seen, times) of rows (text, y): tokens, scores of segments, and of clean texts how often each score occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            out = []
            for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                s = token_scores(text.decode("utf-8", "replace"), scores)
                seen, n = np.unique(np.round(s, 3), return_counts=True) if not y else (np.zeros(0), np.zeros(0, np.int64))
                out.append({"y": y, "n": len(s), "found": [x[2] for x in found_segments(s)], "seen": seen, "times": n})
            schema = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("found", pa.list_(pa.float64())), ("seen", pa.list_(pa.float64())), ("times", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(out, schema)

    told = cut(rows.select("text", "y").mapInArrow(run, "y int, n long, found array<double>, seen array<double>, times array<long>"))
    shared.destroy()  # the rows are written
    return told


def calibrated(told: DataFrame) -> tuple[float, float, np.ndarray]:
    """lambda and K of told_by()'s clean texts, and (y, excess of the best segment, of all significant others) of all: two numbers a text."""
    counted = told.select(F.inline(F.arrays_zip("seen", "times"))).groupBy("seen").agg(F.sum("times").alias("times")).collect()
    scores, times = (np.array([r[k] for r in counted], float) for k in ("seen", "times"))
    clean = told.where((F.col("y") == 0) & (F.size("found") > 0)).select(F.array_max("found").alias("best"), "n").collect()
    lam, k = extreme_values(scores, times, [(r["best"], r["n"]) for r in clean])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law = Model(lam=lam, k=k)
        for batch in batches:
            found = [weighed(x, n, law) for x, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())], ["y", "best", "rest"])

    rows = told.select("y", "n", "found").mapInArrow(run, "y int, best double, rest double").collect()
    return lam, k, np.array([tuple(r) for r in rows], float).reshape(-1, 3)


def train(rows: DataFrame) -> Model:
    """A model from (text, y, part) rows with different texts, parts 0 to 2, cross-fitted.

    Each part is scored by the log-odds of the two others; what that gives for all parts together
    sets lambda, K and the weights. The model's own log-odds come from all rows. So every row counts
    for both, and none is calibrated by log-odds that it taught.
    """
    counts = [cut(token_counts(rows.where(F.col("part") == p))) for p in range(PARTS)]

    def odds(parts: list[int]) -> tuple[dict[str, float], dict[str, float]]:
        some = counts[parts[0]]
        for p in parts[1:]:
            some = some.union(counts[p])
        return log_odds(some.groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))

    laws, seen = [], []
    for p in range(PARTS):
        model = Model(*odds([q for q in range(PARTS) if q != p]))
        if model.tokens or model.stems:
            *law, found = calibrated(told_by(rows.where(F.col("part") == p), model))
            laws.append(law)
            seen.append(found)
        del model  # the driver holds one at a time
    found = np.concatenate(seen) if seen else np.zeros((0, 3))
    whole = Model(*odds(list(range(PARTS))))
    if not whole.tokens and not whole.stems:
        return Model()
    if not len(set(found[:, 0])) == 2:  # too few rows to part: the model's own are all there is
        *law, found = calibrated(told_by(rows, whole))
        laws = [law]
    lam, k = (float(np.exp(np.mean(np.log([x[m] for x in laws])))) for m in (0, 1))
    return Model(whole.tokens, whole.stems, lam, k, tuple(logistic(features(found[:, 1], found[:, 2]), found[:, 0]).tolist()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """A model from a bounded sample of labelled rows, whole texts of any length.

    Bounds: VOCABULARY tokens and stems, those with the largest log-odds; rows_per_class ids of each class, those with the least hash; their texts come by a
    broadcast of these ids. Equal texts teach once. Null ids, labels and texts teach nothing; an id or
    a text that has both labels is toxic. Without both classes the model scores every text near zero.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marked = marked.withColumn("h", F.xxhash64("id", F.lit(7))).where("y in (0, 1)")
    size = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = None
    for y, n in sorted(size.items()):
        share = min(1.0, (rows_per_class + 8 * math.sqrt(rows_per_class)) / n)
        part = marked.where((F.col("y") == y) & within_share(F.col("h"), share)).orderBy("h", "id").limit(rows_per_class)
        some = part if some is None else some.union(part)
    if some is None:
        return Model()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(some.select("id", "y")), "id").withColumn("k", F.sha2("text", 256))
    rows = rows.groupBy("k").agg(F.max("y").alias("y"), F.first("text").alias("text"), F.min("id").alias("id"))
    part = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(PARTS)).cast("int").alias("part")
    return train(stored(rows.select("text", "y", part), "labelled"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, score, predicted, segments) for every row of docs, from its whole text alone.

    score: 0 to 1. predicted: 1 at the threshold or above. segments: (first token, one past the
    last, score) of every significant passage. Null and empty texts, and texts without a letter,
    have the score of no evidence and no segments. Repeated rows each get their row; columns
    beside the two named are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = Scores(m)
        for batch in batches:
            found = [evidence(t.decode("utf-8", "replace") if t else None, scores, m) for t in as_bytes(batch.column(1))]
            p = probability(np.array([x[0] for x in found]), np.array([x[1] for x in found]), m) if found else np.zeros(0)
            spans = [[{"first": a, "end": b, "score": s} for a, b, s in x[2]] for x in found]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(spans, kind)], [id_col, "score", "predicted", "segments"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, score double, predicted int, segments array<struct<first:int,end:int,score:double>>")


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> score, as score() gives it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        scores = Scores(m)
        for texts in parts:
            found = np.array([evidence(t, scores, m)[:2] for t in texts]).reshape(-1, 2)
            yield pd.Series(probability(found[:, 0], found[:, 1], m))

    return run
