"""SentencePiece encoding and decoding by a max-plus scan.

The best segmentation of a text into pieces is a path of largest total score. Over the max-plus
semiring a chunk of text is a matrix: entry (i, j) is the best total of paths that enter the
chunk i characters after its start (where a piece that began before ends) and leave it j
characters after its end. Matrices combine associatively, so a giant text is cut into chunks
that are scored independently; a scan over a text's small matrices fixes where its best path
crosses each chunk border, and each chunk is then backtraced on its own.

The vocabulary file ranks its pieces; a piece's score is the log of its probability under
Zipf's law over those ranks, in whole millionths, so that sums are exact in any grouping and
the result doesn't depend on the chunks. Ties go to the longest last piece. A character without
a piece costs ``unknown`` and becomes its UTF-8 byte pieces, so that decoding gives back every
text exactly.

Within a chunk, paths must pass the places between a non-mark and a mark (▁, the space), as no
piece crosses them. The text between two such places is a word; the path through a word is found
once and kept. Nor does a piece cross a border of letters and other characters, so that a word's
parts are found apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import batched

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import as_bytes, cut, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of a chunk; longer texts are giant.
CHUNK = 32_768
#: Words whose path a Python worker keeps in each of two generations; a word that is used again moves to the younger.
KEPT_WORDS = 200_000
#: Chunks that travel in one batch.
SENT = 64

#: Words: marks and what follows them.
_WORD = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Parts of a word: letters, or none, each with the marks before it.
_PART = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*(?:(?!{MARK})[\W\d_])+|{MARK}+")
#: Stands for a true U+2581 of a text while it is encoded; no valid text holds it.
TRUE_MARK = "\udc81"
NEG = -np.inf
#: Chunks whose matrices are multiplied in one group.
FAN = 256


class Pieces:
    """The pieces of a model file, with the best path of a word and of a part of a text."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        # pieces with a mark after other text would cross words
        normal = [i for i in normal if MARK not in self.text[i].lstrip(MARK)]
        normal.sort(key=lambda i: (-sp.get_score(i), i))
        harmonic = sum(1 / r for r in range(1, len(normal) + 1))
        self.piece = {self.text[i]: (float(-round(1e6 * math.log(r * harmonic))), i) for r, i in enumerate(normal, 1)}
        self.unknown = min(s for s, _ in self.piece.values()) - 10e6
        self.longest = max(map(len, self.piece))
        #: What a piece begins with: () unless it is a piece itself.
        self.begins = {t[:n]: self.piece.get(t[:n], ()) for t in self.piece for n in range(1, len(t) + 1)}
        # no piece crosses the parts of a word, in most vocabularies
        self.apart = all(len(_PART.findall(t)) == 1 for t in self.piece)
        self.chars = {t for t in self.piece if len(t) == 1}
        self.finder = ahocorasick.Automaton()
        for t, (s, i) in self.piece.items():
            self.finder.add_word(t, (len(t), s, i))
        self.finder.make_automaton()
        #: Paths of words, of words that follow a single space, and of parts: the younger generation and the elder.
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.elder: dict[int, dict[str, bytes]] = {}
        self.of_byte = {i: b for b, i in self.byte.items()}
        # a byte that begins a character bears the cost of the character
        self.cost = np.array([(self.unknown if self.of_byte[i] & 0xC0 != 0x80 else 0.0) if i in self.of_byte else self.piece.get(t, (0.0, 0))[0] for i, t in enumerate(self.text)])
        #: The bytes of each piece.
        self.plain = pa.array([bytes([self.of_byte[i]]) if i in self.of_byte else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)], pa.large_binary())

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in (MARK if char == TRUE_MARK else char).encode()]

    def lattice(self, text: str, begin: dict[int, float], upto: int, reach: int) -> tuple[list[float], list[tuple[int, int]]]:
        """Best totals of paths to each place from the given places; pieces begin before upto and end by reach."""
        best, back = [NEG] * (reach + 1), [(-1, -1)] * (reach + 1)
        for i, s in begin.items():
            best[i] = s
        begins, unknown = self.begins.get, self.unknown
        for i in range(upto):
            here = best[i]
            if here == NEG:
                continue
            j = i + 1
            if text[i] not in self.piece and (total := here + unknown) > best[j]:
                best[j], back[j] = total, (i, -1)
            while j <= reach and (found := begins(text[i:j])) is not None:
                if found and (total := here + found[0]) > best[j]:
                    best[j], back[j] = total, (i, found[1])
                j += 1
        return best, back

    def path(self, text: str, back: list[tuple[int, int]], at: int, stop: int) -> list[int]:
        ids: list[int] = []
        while at > stop:
            i, k = back[at]
            ids += [k] if k >= 0 else self.bytes_of(text[i])[::-1]
            at = i
        return ids[::-1]

    def best(self, word: str) -> list[int]:
        n = len(word)
        if not self.chars.issuperset(word):
            return self.path(word, self.lattice(word, {0: 0.0}, n, n)[1], n, 0)
        # all pieces in the word, by their ends and the longest first
        total, back = [0.0] + [NEG] * n, [(0, 0)] * (n + 1)
        for last, (size, s, k) in self.finder.iter(word):
            start = last + 1 - size
            if (here := total[start] + s) > total[last + 1]:
                total[last + 1], back[last + 1] = here, (start, k)
        ids = []
        while n:
            n, k = back[n]
            ids.append(k)
        return ids[::-1]

    def keep(self, kept: dict[str, bytes], word: str, key: str) -> bytes:
        """The ids of a whole word as int32 bytes, kept unless the word is long."""
        elder = self.elder.setdefault(id(kept), {})
        ids = elder.get(key)
        if ids is None:
            parts = _PART.findall(word) if self.apart and kept is not self.parts else ()
            if len(parts) > 1:
                ids = b"".join([self.parts.get(x) or self.keep(self.parts, x, x) for x in parts])
            else:
                ids = np.array(self.best(word), np.int32).tobytes()
        if len(word) <= 64:
            if len(kept) >= KEPT_WORDS:
                self.elder[id(kept)] = dict(kept)
                kept.clear()
            kept[key] = ids
        return ids

    def words(self, text: str) -> bytes:
        """The ids of a marked text that begins and ends between words."""
        get, keep, known = self.known.get, self.keep, self.known
        return b"".join([get(w) or keep(known, w, w) for w in _WORD.findall(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as int32 bytes; none for an empty text."""
        if not text:
            return b""
        parts = text.split(" ")
        if "" in parts or MARK in text:
            return self.words(marked(text))
        get, keep, spaced = self.spaced.get, self.keep, self.spaced
        return b"".join([get(w) or keep(spaced, MARK + w, w) for w in parts])

    def score(self, ids: np.ndarray) -> float:
        """The total of a marked text's ids; a run of byte pieces is as many unknown characters as it encodes."""
        return float(self.cost[ids].sum())

    def decode(self, ids: list[bytes | None]) -> Iterator[memoryview | None]:
        """The bytes of the text that each row of int32 bytes stands for."""
        found = self.plain.take(pa.array(np.frombuffer(b"".join(x or b"" for x in ids), np.int32)))
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
        data, at = memoryview(found.buffers()[2] or b"").cast("B"), 0
        for x, stop in zip(ids, ends[np.cumsum([len(x or b"") // 4 for x in ids], dtype=np.int64)].tolist(), strict=True):
            # the space that was put before the text goes
            yield None if x is None else data[at + (stop > at and data[at] == 32) : stop]
            at = stop

    # ---- chunks ---------------------------------------------------------------------------

    def cuts(self, text: str, upto: int) -> tuple[int, int]:
        """The first and last place in [0, upto] that every path passes: before a mark that follows another character."""
        found = re.search(rf"[^{MARK}]{MARK}", text[:upto + 1])
        if not found:
            return -1, -1
        last = upto
        while not (text[last : last + 1] == MARK and text[last - 1] != MARK):
            last -= 1
        return found.start() + 1, last

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Entry (i, j): the best total from i characters after the start to j after the end at size.

        text goes on beyond size by the longest piece less one, as far as there is text.
        """
        w, reach = self.longest, len(text)
        out = np.full((w, w), NEG)
        first, last = self.cuts(text, size)
        if first < 0:
            for i in range(min(w, reach + 1)):
                best, _ = self.lattice(text, {i: 0.0}, size, reach)
                out[i, : reach - size + 1] = best[size : reach + 1]
            return out
        middle = self.score(np.frombuffer(self.words(text[first:last]), np.int32))
        tail, _ = self.lattice(text[last:], {0: 0.0}, size - last, reach - last)
        for i in range(min(w, first + 1)):
            head, _ = self.lattice(text[i:first], {0: 0.0}, first - i, first - i)
            out[i, : reach - size + 1] = np.array(tail[size - last : reach - last + 1]) + (head[first - i] + middle)
        return out

    def between(self, text: str, size: int, enter: int, leave: int) -> list[int]:
        """The ids of the best path from enter to size + leave."""
        end = size + leave
        first, last = self.cuts(text, size)
        if first < 0 or first < enter:
            _, back = self.lattice(text, {enter: 0.0}, size, end)
            return self.path(text, back, end, enter)
        _, head = self.lattice(text[enter:first], {0: 0.0}, first - enter, first - enter)
        _, tail = self.lattice(text[last:end], {0: 0.0}, size - last, end - last)
        middle = np.frombuffer(self.words(text[first:last]), np.int32).tolist()
        return [*self.path(text[enter:first], head, first - enter, 0), *middle, *self.path(text[last:end], tail, end - last, 0)]


def marked(text: str) -> str:
    """The text with a space put before it and each space as a mark."""
    return MARK + text.replace(MARK, TRUE_MARK).replace(" ", MARK)


_PIECES: dict[str, Pieces] = {}


def pieces(model_file: str) -> Pieces:
    """The model's pieces, read once in each Python worker."""
    if model_file not in _PIECES:
        _PIECES[model_file] = Pieces(model_file)
    return _PIECES[model_file]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray], enter: int, leave: int) -> list[tuple[int, int]]:
    """Where the best path from enter to leave enters and leaves each of a sequence of matrices."""
    width = len(matrices[0])
    v = np.full(width, NEG)
    v[enter] = 0.0
    before = []
    for m in matrices:
        before.append(v)
        v = (v[:, None] + m).max(axis=0)
    out = []
    for v, m in zip(before[::-1], matrices[::-1], strict=True):
        at = int(np.argmax(v + m[:, leave]))
        out.append((at, leave))
        leave = at
    return out[::-1]


def _array(rows: pd.Series, width: int) -> list[np.ndarray]:
    return [np.frombuffer(b, np.float64).reshape(width, width) for b in rows]


def _lists(ids: list[bytes | None]) -> pa.Array:
    """int32 bytes as an array of lists."""
    ends = np.cumsum([0] + [len(x or b"") // 4 for x in ids]).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), np.int32))
    mask = pa.array([x is None for x in ids])
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=mask)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(id_col, ids, n_tokens, round_trip) for every row of docs.

    ids: the best segmentation of the whole text, of any length. round_trip: whether decoding
    the ids gives the text back; it always does. A null text has null ids, n_tokens and
    round_trip; an empty one has no ids. Repeated rows and ids each keep their row. Texts over
    ``chunk`` characters are cut into chunks; equal ones are encoded once. Columns beside the two
    named are ignored.
    """
    if chunk < 64:
        raise ValueError("a chunk has 64 characters at least")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_file)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [None if t is None else p.encode(t) for t in part.column(1).to_pylist()]
                n = [None if x is None else len(x) // 4 for x in ids]
                same = [None if x is None else x == t for x, t in zip(p.decode(ids), as_bytes(part.column(1)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["id", "ids", "n_tokens", "round_trip"])

    schema = f"id {kind}, ids array<int>, n_tokens long, round_trip boolean"
    length = F.coalesce(F.length("text"), F.lit(0))
    done = rows.where(length <= chunk).mapInArrow(short, schema)
    giant = rows.where(length > chunk).withColumn("key", F.sha2("text", 256))
    coded = encode_giant(giant.select("key", "text").dropDuplicates(["key"]), model_file, chunk)
    coded = coded.withColumn("round_trip", F.sha2(decode_column(model_file)("ids"), 256) == F.col("key"))
    long = giant.select("id", "key").join(cut(coded), "key").select("id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")
    return done.union(long).withColumnRenamed("id", id_col)


def encode_giant(texts: DataFrame, model_file: str, chunk: int) -> DataFrame:
    """(key, ids) for distinct (key, text): the parallel scan."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = pieces(model_file).longest - 1
        schema = pa.schema([("key", pa.string()), ("n", pa.int32()), ("last", pa.int32()), ("own", pa.int32()), ("part", pa.binary())])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = marked(text.as_py())
                    last = max(0, (len(text) - 1) // chunk)
                    for n in range(last + 1):
                        part = text[n * chunk : (n + 1) * chunk + ahead]
                        yield key, n, last, min(chunk, len(text) - n * chunk), part.encode("utf-8", "surrogatepass")

        for some in batched(rows(), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    split = texts.mapInArrow(chunks, "key string, n int, last int, own int, part binary")
    split = cut(split.repartition(F.col("key"), F.col("n")))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_file)
        for batch in batches:
            m = [p.matrix(x.decode("utf-8", "surrogatepass"), own).tobytes() for own, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(m, pa.binary())], ["key", "n", "last", "m"])

    scored_chunks = split.mapInArrow(scored, "key string, n int, last int, m binary").withColumn("block", F.floor(F.col("n") / FAN).cast("int"))
    scored_chunks = cut(scored_chunks)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        m = _array(pdf["m"], pieces(model_file).longest)
        out = m[0]
        for x in m[1:]:
            out = times(out, x)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "block": pdf["block"].iloc[:1], "m": [out.tobytes()]})

    def crossings(name: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(name)
            enter, leave = (int(pdf[c].iloc[0]) if c in pdf else 0 for c in ("enter", "leave"))
            found = scan(_array(pdf["m"], pieces(model_file).longest), enter, leave)
            return pd.DataFrame({"key": pdf["key"], name: pdf[name], "enter": [a for a, _ in found], "leave": [b for _, b in found]})

        return run

    blocks = scored_chunks.groupBy("key", "block").applyInPandas(product, "key string, block int, m binary")
    blocks = blocks.groupBy("key").applyInPandas(crossings("block"), "key string, block int, enter int, leave int")
    inner = scored_chunks.select("key", "n", "block", "m").join(cut(blocks), ["key", "block"])
    crossed = inner.groupBy("key", "block").applyInPandas(crossings("n"), "key string, n int, enter int, leave int")

    def traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_file)
        for batch in batches:
            key, n, own, part, enter, leave = (c.to_pylist() for c in batch.columns)
            ids = [np.array(p.between(x.decode("utf-8", "surrogatepass"), o, a, b), np.int32).tobytes() for o, x, a, b in zip(own, part, enter, leave, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ids)], ["key", "n", "ids"])

    paths = split.join(cut(crossed), ["key", "n"]).select("key", "n", "own", "part", "enter", "leave").mapInArrow(traced, "key string, n int, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("n", "ids")))
    return paths.groupBy("key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def decode_column(model_file: str = MODEL):
    """A column function: ids -> text; null for null."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        found = pieces(model_file).decode([None if x is None else np.asarray(x, np.int32).tobytes() for x in ids])
        return pd.Series([None if x is None else str(x, "utf-8", "replace") for x in found], dtype=object)

    return decoded


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str = MODEL) -> DataFrame:
    """(id_col, text) for every row: the text that the ids stand for; null for null ids."""
    return coded.select(F.col(id_col), decode_column(model_file)(F.col(ids_col)).alias("text"))
