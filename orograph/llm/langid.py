"""Language identification by cross-parsing entropy.

For each language a suffix automaton of its labelled text is built. A text is parsed greedily
into the longest phrases that occur in the language's text; the fewer phrases a byte needs, the
closer the text is to the language (Ziv-Merhav cross parsing). The automaton never follows
suffix links here, as a phrase always starts anew at the root, so that each automaton becomes a
table from (state, byte class) to (state, whether a phrase ended), and whole batches of texts
are parsed by one table lookup per byte.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Parsing restarts after so many bytes, so that a text of any length is many short rows of work. That ends
#: one phrase early in each segment, in every language alike: at most one phrase more in 4,096 bytes.
SEGMENT = 4096
#: Bytes parsed at a time.
BATCH_BYTES = 1 << 21

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class Model:
    """Per language, bytes of labelled text. classes: the class of each byte; 0 is unseen."""

    langs: tuple[str, ...]
    texts: tuple[bytes, ...]
    key: int = field(default=0)


def folded(text: bytes) -> np.ndarray:
    """Byte values with ASCII letters lowered and runs of other ASCII bytes made one space."""
    raw = np.frombuffer(text, np.uint8)
    low = _FOLD[raw]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    return low[keep]


_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every factor of the sequence."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def parse_table(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, table): table[state * classes + class] = 2 * next state + phrase ended before."""
    symbols = folded(text)
    seen = np.unique(symbols)
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    classes = classes[_FOLD]
    width = len(seen) + 1
    step = suffix_automaton(np.searchsorted(seen, symbols).__add__(1).tolist())
    root = np.ones(width, np.int32)  # an unseen byte is a phrase of its own
    for c, q in step[0].items():
        root[c] = 2 * q + 1
    table = np.tile(root, (len(step), 1))
    for state, moves in enumerate(step):
        if moves:
            table[state, list(moves)] = [2 * q for q in moves.values()]
    table[0] = root
    return classes, table.reshape(-1)


_TABLES: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def tables(model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """The model's tables, built once in each Python worker."""
    if model.key not in _TABLES:
        _TABLES.clear()
        _TABLES[model.key] = [parse_table(t) for t in model.texts]
    return _TABLES[model.key]


def phrase_counts(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of each text in each language, bytes that were parsed)."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    low = _FOLD[raw]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    before = np.r_[0, np.cumsum(keep)]
    begin = np.cumsum(size + 1) - size - 1
    start, stop = before[begin], before[begin + size]
    low = low[keep]
    pieces = -(-(stop - start) // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    seg = start[owner] + nth * SEGMENT
    length = np.minimum(SEGMENT, stop[owner] - seg)
    order = np.argsort(-length, kind="stable")
    seg, owner, length = seg[order], owner[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    for k, (classes, table) in enumerate(tables(model)):
        symbols, width = classes[low], int(classes.max()) + 1
        state, ended = np.zeros(len(seg), np.int32), np.zeros(len(seg), np.int32)
        for t, n in enumerate(active.tolist()):
            x = table[state[:n] * width + symbols[seg[:n] + t]]
            ended[:n] += x & 1
            state[:n] = x >> 1
        out[:, k] = np.bincount(owner, ended, len(texts)).astype(np.int64)
    return out, stop - start


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def lettered(text: Column) -> Column:
    """True where a text isn't null and has a letter: where it gets a language if any was learned."""
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(texts: list[bytes | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, normalised phrases of the best language) of each text."""
    lang, score, best = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
    rows = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if not model.langs:
        return lang, score, best
    at = 0
    while at < len(rows):
        some, total = [], 0
        while at < len(rows) and (not some or total < BATCH_BYTES):
            some.append(rows[at])
            total += len(texts[rows[at]])
            at += 1
        counts, length = phrase_counts([texts[i] for i in some], model)
        per = np.array([math.log2(max(2, len(t))) for t in model.texts])
        h = counts * per[None, :] / np.maximum(1, length)[:, None]
        first = h.argmin(axis=1)
        low = h[np.arange(len(some)), first]
        h[np.arange(len(some)), first] = np.inf
        second = h.min(axis=1)
        for i, k, a, b in zip(some, first, low, second, strict=True):
            lang[i], best[i] = model.langs[k], a
            score[i] = 1.0 if not np.isfinite(b) else 1.0 - a / b if b > 0 else 0.0
    return lang, score, best


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", total_bytes: int = 160_000, docs_per_lang: int = 400, excerpt: int = 4000) -> Model:
    """A model from a bounded sample of labelled rows.

    Bounds: docs_per_lang rows of each language (those with the least hash of their text), an
    excerpt of up to so many characters from the middle of each, and total_bytes over all languages, each
    getting an equal share: every label is learned, the more of them the less of each (fewer rows, too:
    one for each 100 bytes of the share). Rows with null text or label teach nothing. Languages are
    taken in alphabetical order, which decides ties.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and length(text) > 0")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model((), ())
    share = max(1, total_bytes // len(sizes))
    docs_per_lang = max(1, min(docs_per_lang, share // 100))
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    least = 8.0 * math.sqrt(docs_per_lang) + 2.0 * docs_per_lang  # a hash below this share of it gives enough rows
    rates = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, least / n)))])
    some = rows.withColumn("h", h).where(F.col("h") < F.element_at(rates, F.col("lang")) * (1 << 30))
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.sha2("text", 256)))).where(F.col("n") <= docs_per_lang)
    begin = F.greatest(F.lit(1), ((F.length("text") - excerpt) / 2).cast("int"))
    got = some.select("lang", "n", F.substring("text", begin, F.lit(excerpt)).alias("text")).toPandas().sort_values(["lang", "n"])
    langs, texts = [], []
    for lang, part in got.groupby("lang"):
        joined = b" ".join(t.encode() for t in part["text"])[:share]
        if any(map(str.isalpha, joined.decode("utf-8", "ignore"))):
            langs.append(lang)
            texts.append(joined)
    return Model(tuple(langs), tuple(texts), hash((tuple(langs), tuple(texts))))


def detector(docs: DataFrame, model: Model):
    """A column function: text -> struct(lang, score, entropy)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, entropy double")
    def detect(texts: pd.Series) -> pd.DataFrame:
        lang, score, best = predict([None if t is None else t.encode("utf-8", "ignore") for t in texts], shared.value)
        return pd.DataFrame({"lang": lang, "score": score, "entropy": best})

    return detect


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, entropy) for every row of docs, from its text alone.

    lang_pred is one of the model's languages, or ``und`` with score 0 where the text is null or
    has no letter. score is 1 - best / second best of the normalised phrase counts, 1 where there
    is one language only. entropy is the best count: bits per byte, null for ``und``. Repeated
    rows each get their row; columns beside the two named are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, best = predict(batch.column(1).cast(pa.binary()).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(best, from_pandas=True)], [id_col, "lang_pred", "score", "entropy"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, lang_pred string, score double, entropy double")
