"""Benchmark decontamination by pigeonhole edit matching.

An item with a budget of e edits is split into e + 1 pieces: e edits leave at least one of them
whole, so that every occurrence within the budget holds an exact piece. One Aho-Corasick pass
over a text finds all pieces of all items; each hit fixes a window of the text, and Myers'
bit-parallel algorithm gives the least edit distance of the item to any part of that window.

Verification is hierarchical: 2, then 4, then 8 pieces in a row (and so on) that hold the hit are
compared first, j pieces with a budget of j - 1. An occurrence within the whole budget has some
piece for which all of these fit, as the budgets of pieces side by side, each plus one, add up to
the whole budget plus one. So chance hits cost a few steps and no occurrence is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orograph.llm.common import as_bytes

#: Edits allowed for each byte of an item.
RATE = 0.1
#: Texts of one automaton; more are looked for in further passes.
BLOCK_ITEMS = 20_000
#: Bytes of a text that are searched at a time.
BLOCK_BYTES = 4 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def normal(text: bytes) -> str:
    """Letters lowered, all other ASCII than letters and digits made single spaces; one char a byte."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return b" ".join(text.translate(_FOLD).split()).decode("latin-1")


def searched(text: bytes) -> str:
    """normal(), with a space at both ends, as items that must match whole words hold the spaces around them."""
    return f" {normal(text)} "


@dataclass(frozen=True)
class Item:
    item_id: object
    text: str
    budget: int


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal size that together are the text."""
    n = len(text)
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def patterns(text: str) -> dict[str, int]:
    """For Myers: the bits at which each character stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(bits: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of the window, where the first such part ends)."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    get = bits.get
    for i, c in enumerate(window):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return best, end


def fits(bits: dict[str, int], m: int, window: str, budget: int) -> bool:
    """Whether the pattern is within the budget of some part of the window."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    get = bits.get
    for c in window:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= budget:
                return True
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return False


class Matcher:
    """All items of a block, searched for in one pass."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.bits = [patterns(x.text) for x in items]
        found: dict[str, list[tuple[int, int]]] = {}
        # of each item and piece: (first, end, budget, bits) of 2, 4, 8, ... pieces in a row that hold it
        self.above: dict[tuple[int, int], list[tuple[int, int, int, dict[str, int]]]] = {}
        for n, item in enumerate(items):
            parts = pieces(item.text, item.budget)
            ends = [a for a, _ in parts] + [len(item.text)]
            for offset, piece in parts:
                found.setdefault(piece, []).append((n, offset))
                self.above[n, offset] = []
            span = 2
            while span < len(parts):
                for i in range(0, len(parts), span):
                    j = min(i + span, len(parts))
                    if j - i > span // 2:
                        row = (ends[i], ends[j], j - i - 1, patterns(item.text[ends[i] : ends[j]]))
                        for offset, _ in parts[i:j]:
                            self.above[n, offset].append(row)
                span *= 2
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.reach = max((len(x.text) + 2 * x.budget for x in items), default=0)
        self.empty = not found

    def search(self, text: str) -> dict[int, int]:
        """Place in items -> least distance, for items within their budget somewhere in the text."""
        best: dict[int, int] = {}
        if self.empty:
            return best
        at = 0
        while True:
            part = text[at : at + BLOCK_BYTES + self.reach]
            self.within(part, best)
            at += BLOCK_BYTES
            if at + self.reach >= len(text) or not part:
                return best

    def within(self, text: str, best: dict[int, int]) -> None:
        done: set[tuple[int, int]] = set()
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                if best.get(n) == 0:
                    continue
                item = self.items[n]
                start = last + 1 - size - offset
                # windows of one item that lie close together are searched as one
                cell = start // (item.budget + 1)
                if (n, cell) in done:
                    continue
                if not all(fits(bits, b - a, text[max(0, start + a - e) : start + b + e], e) for a, b, e, bits in self.above[n, offset]):
                    continue
                done.add((n, cell))
                base = cell * (item.budget + 1)
                a, b = max(0, base - item.budget), base + 2 * item.budget + 1 + len(item.text)
                d, _ = myers(self.bits[n], len(item.text), text[a:b])
                if d <= item.budget and d < best.get(n, 1 << 30):
                    best[n] = d


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = RATE) -> Iterator[list[Item]]:
    """The items in blocks, all texts of an id in one. Items without a letter or digit, or without id, match nothing."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    block: list[Item] = []
    for r in rows.orderBy("id", "text").toLocalIterator():
        if len(block) >= BLOCK_ITEMS and block[-1].item_id != r["id"]:
            yield block
            block = []
        if text := normal(r["text"].encode("utf-8", "replace")):
            budget = int(len(text) * rate)
            # without an edit to allow, a short item would be found within words
            block.append(Item(r["id"], text if budget else f" {text} ", budget))
    if block:
        yield block


_MATCHERS: dict[str, Matcher] = {}


def matcher_of(key: str, items: list[Item]) -> Matcher:
    """The matcher of a block, built once in each Python worker."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items)
    return _MATCHERS[key]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id_col, item_col, distance, budget): every item in every row of docs within its budget of edits.

    The budget is rate for each byte of the normalised item; an item too short for one edit (under 10
    bytes at 0.1) matches whole words only. distance is the least edit distance
    of the item to any part of the normalised text. Null and empty texts hold nothing. A row of
    docs gives one row for each item that it holds, repeated rows each their own; an item id, of any
    type, with several texts gives the least distance over them, and of equal ones the least budget.
    Columns beside those named are ignored. The benchmark is a stated query set: it is taken in
    blocks of about BLOCK_ITEMS texts, each broadcast and compared with all rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    items_kind = dict(benchmark.dtypes)[item_col]
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {rows.dtypes[0][1]}, `{item_col}` {items_kind}, distance int, budget int"
    out = None
    for block in items_of(benchmark, item_col, item_text_col, rate):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, shared.value)
            for batch in batches:
                place, item, distance, budget = [], [], [], []
                for i, text in enumerate(as_bytes(batch.column(1))):
                    found: dict[object, tuple[int, int]] = {}
                    for n, d in (matcher.search(searched(text)) if text else {}).items():
                        x = matcher.items[n]
                        found[x.item_id] = min(found.get(x.item_id, (1 << 30, 0)), (d, x.budget))
                    for k, (d, e) in found.items():
                        place.append(i)
                        item.append(k)
                        distance.append(d)
                        budget.append(e)
                ids = batch.column(0).take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, item_type), pa.array(distance, pa.int32()), pa.array(budget, pa.int32())], [id_col, item_col, "distance", "budget"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item within its budget. Null texts stay."""
    out = docs
    for block in items_of(benchmark, item_col, item_text_col, rate):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, shared.value)
            for batch in batches:
                texts = as_bytes(batch.column(batch.schema.get_field_index(text_col)))
                yield batch.filter(pa.array([not (t and matcher.search(searched(t))) for t in texts], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
