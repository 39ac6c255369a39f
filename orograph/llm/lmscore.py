"""Cross-entropy difference of documents under two matched n-gram models.

A target and a background bigram model share one vocabulary: all words of all documents. Each
token's loss under the target model less that under the background model, averaged, scores a
document: the lower, the more like the target (Moore and Lewis). The background holds all
documents that aren't in the target, and a document's own n-grams are taken off the counts of its
model before it is scored, so that no document is told by itself.

Nothing is capped or hashed together: n-grams travel as text. Documents are packed into chunks
with their own dictionaries; each chunk sends its different n-grams once, in alphabetical order
and with their counts, to the buckets of their hashes, which send the totals back in the same
order. A bucket holds what one eighth as many chunks as there are buckets send to it: the buckets
grow in number with the chunks, and the pairs of one word spread over an eighth of them. A common
n-gram costs its bucket one entry a chunk, which is what a task's memory grows with: by some ten
bytes for each 8 MB of text.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import as_bytes, cut, slices, spans, stored, text_blocks

#: Bytes of text that are packed into a chunk.
PACKED = 1 << 23
#: Buckets of n-grams, at least; more than eight times as many chunks have an eighth of their number.
BUCKETS = 128
#: The pairs of one first word go to so many buckets, or to one in SHARE if that is more, so that no word makes a bucket much larger than others.
SPREAD, SHARE = 4, 8
#: Of Zstandard.
LEVEL = 3
#: Dirichlet smoothing of a bigram by the unigram, in counts.
MU = 200.0

_WORD = re.compile(r"[^\W_]+")


def squeezed(data: bytes) -> bytes:
    """Zstandard, after the eight bytes of the length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of four bytes, squeezed byte by byte: the high ones are mostly zero."""
    return squeezed(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueezed(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0]


def lines(words: pa.Array) -> bytes:
    """Words, each with a line end."""
    ended = pc.binary_join_element_wise(words, *(pa.scalar(x, words.type) for x in ("\n", "")))
    ends = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return ended.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if len(ended) else b""


def from_lines(data: bytes) -> pa.Array:
    """The words of lines."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    at = pa.py_buffer(np.concatenate([[0], ends + 1]).astype(np.int64).tobytes())
    whole = pa.Array.from_buffers(pa.large_string(), len(ends), [None, at, pa.py_buffer(data)])
    return pc.utf8_rtrim(whole, "\n")


def grams_of(words: pa.Array, first: pa.Array, runs: np.ndarray, second: pa.Array) -> pa.Array:
    """The words, and the pairs: each of the first words with as many of the second as its run."""
    both = pc.binary_join_element_wise(first.take(pa.array(np.repeat(np.arange(len(runs)), runs))), second, pa.scalar(" ", pa.large_string()))
    return pa.concat_arrays([words, both])


def packed(rows: DataFrame) -> DataFrame:
    """(chunk, ids, size, words, names) from (id, text): texts as numbers of the chunk's own words, 4 bytes each, squeezed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, 1, PACKED)):
            index: defaultdict[str, int] = defaultdict()
            index.default_factory = index.__len__
            words, size = [], []
            for text in as_bytes(batch.column(1)):
                parts = [np.fromiter(map(index.__getitem__, _WORD.findall(part.lower())), np.uint32) for part in text_blocks(text.decode("utf-8", "replace") if text else None)]
                words += parts
                size.append(sum(map(len, parts)))
            # numbered by the alphabet, so that n-grams that stand together have much in common
            names = sorted(index)
            number = np.empty(len(names), np.uint32)
            number[[index[w] for w in names]] = np.arange(len(names), dtype=np.uint32)
            flat = number[np.concatenate(words)] if words else number[:0]
            ends = pa.array([0, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c) for c in (batch.column(0), pa.array(size, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists, pa.array([planes(flat)], pa.binary()), pa.array([squeezed(" ".join(names).encode())], pa.binary())], ["chunk", "ids", "size", "words", "names"])
            at += 1

    return rows.mapInArrow(run, f"chunk long, ids array<{rows.dtypes[0][1]}>, size array<long>, words binary, names binary")


def numbered(words: np.ndarray, size: np.ndarray, names: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens that follow another, different pairs, number of the pair of each such token, order of words and then pairs by bucket, buckets in that order)."""
    follows = np.ones(len(words), bool)
    follows[(np.cumsum(size) - size)[size > 0]] = False
    at = np.flatnonzero(follows)
    pairs, pair = np.unique(words[at - 1].astype(np.int64) * len(names) + words[at], return_inverse=True)
    h = np.fromiter((zlib.crc32(w.encode()) for w in names), np.uint64, len(names))
    first, second = np.divmod(pairs, max(1, len(names)))
    # pairs of one first word go to a part of the buckets, where they stand together and squeeze well
    part = h[second] * np.uint64(0x94D049BB133111EB) >> np.uint64(32)
    x = np.concatenate([h, (h[first] << np.uint64(24) | part % np.uint64(max(SPREAD, buckets // SHARE))) + np.uint64(1 << 60)]) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return at, pairs, pair, order, bucket[order]


def gram_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, n_words, words, first, runs, second, target, n): the n-grams of a chunk and bucket, see grams_of(), and their counts; all squeezed."""
    names_of = ["chunk", "bucket", "words", "first", "runs", "second", "target", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names = unsqueezed(batch.column("names")[r].as_py()).decode().split()
                if not names:
                    continue
                size = np.asarray(batch.column("size")[r].values)
                words = from_planes(batch.column("words")[r].as_py())
                flags = np.zeros(len(size), bool)
                flags[np.asarray(batch.column("chosen")[r].as_py() or [], np.int64)] = True
                chosen = np.repeat(flags, size)
                at, pairs, pair, order, bucket = numbered(words, size, names, buckets)
                total = [np.concatenate([np.bincount(words[k], minlength=len(names)), np.bincount(pair[k[at]], minlength=len(pairs))])[order] for k in (chosen, np.ones(len(words), bool))]
                text = pa.array(names, pa.large_string())
                first, second = np.divmod(pairs, len(names))
                parts: list[list[bytes]] = [[] for _ in range(6)]
                runs = spans(bucket)
                for a, b in runs:
                    own = order[a:b]
                    own, both = own[own < len(names)], own[own >= len(names)] - len(names)
                    heads = first[both]
                    starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]][: len(heads)])
                    parts[0].append(squeezed(lines(text.take(pa.array(own)))))
                    parts[1].append(squeezed(lines(text.take(pa.array(heads[starts])))))
                    parts[2].append(planes(np.diff(np.r_[starts, len(heads)])))
                    parts[3].append(squeezed(lines(text.take(pa.array(second[both])))))
                    for k, n in enumerate(total):
                        parts[4 + k].append(planes(n[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("chunk")[r].as_py()] * len(runs), pa.int64()), pa.array([bucket[a] for a, _ in runs], pa.int32()), *[pa.array(x, pa.binary()) for x in parts]], names_of
                )

    return chunks.mapInArrow(run, "chunk long, bucket int, words binary, first binary, runs binary, second binary, target binary, n binary")


def gram_totals(counted: DataFrame) -> DataFrame:
    """(chunk, bucket, target, n): for each n-gram of a chunk and bucket its counts over all chunks, eight bytes each, squeezed."""

    def run(t: pa.Table) -> pa.Table:
        columns = [t.column(c).to_pylist() for c in ("words", "first", "runs", "second", "target", "n")]
        grams = [grams_of(from_lines(unsqueezed(w)), from_lines(unsqueezed(f)), from_planes(r), from_lines(unsqueezed(s))) for w, f, r, s in zip(*columns[:4], strict=True)]
        edge = np.cumsum([0, *map(len, grams)]).tolist()
        at = np.asarray(pa.concat_arrays(grams).dictionary_encode().indices)
        out = []
        for c in columns[4:]:
            total = np.zeros(int(at.max()) + 1, np.int64)
            np.add.at(total, at, np.concatenate([from_planes(x) for x in c]).astype(np.int64))
            whole = total[at]
            out.append(pa.array([squeezed(whole[a:b].tobytes()) for a, b in zip(edge, edge[1:], strict=False)], pa.binary()))
        return pa.table([t.column("chunk"), t.column("bucket"), *out], ["chunk", "bucket", "target", "n"])

    return counted.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, target binary, n binary")


def own_counts(owner: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often each token's n-gram occurs in the token's own document."""
    _, at, n = np.unique(owner * (int(gram.max(initial=0)) + 1) + gram, return_inverse=True, return_counts=True)
    return n[at]


def scored(chunks: DataFrame, totals: DataFrame, id_col: str, n_tokens: tuple[int, int], n_words: int, buckets: int) -> DataFrame:
    """The rows of cross_entropy_difference; n_tokens: of the target and of all, n_words: different ones and the unknown word."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, size = left.column("ids").combine_chunks().values, np.asarray(left.column("size").combine_chunks().values)
        words = from_planes(left.column("words")[0].as_py())
        sums = [np.zeros(len(size))] * 2
        if len(words):
            names = unsqueezed(left.column("names")[0].as_py()).decode().split()
            at, _, pair, order, _ = numbered(words, size, names, buckets)
            right = right.sort_by("bucket")
            owner = np.repeat(np.arange(len(size)), size)
            mine = np.zeros(len(size), bool)
            mine[np.asarray(left.column("chosen")[0].as_py() or [], np.int64)] = True
            total = np.empty((2, len(order)), np.int64)
            for m, c in enumerate(("target", "n")):
                total[m, order] = np.frombuffer(b"".join(map(unsqueezed, right.column(c).to_pylist())), np.int64)
            total[1] -= total[0]
            own, own_pair = own_counts(owner, words), own_counts(owner[at], pair)
            for m, tokens in enumerate((n_tokens[0], n_tokens[1] - n_tokens[0])):
                # whose counts hold the document itself
                self_ = mine if m == 0 else ~mine
                off = self_[owner]
                unigram, bigram = total[m, : len(names)][words] - own * off, total[m, len(names) :][pair] - own_pair * off[at]
                p = (unigram + 1.0) / (tokens - (size * self_)[owner] + n_words)
                loss = -np.log(p)
                loss[at] = -np.log((bigram + MU * p[at]) / (unigram[at - 1] + MU))
                sums[m] = np.bincount(owner, loss, len(size)) / np.maximum(size, 1)
        return pa.table([ids, pa.array(size), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[0] - sums[1])], [id_col, "n_tokens", "target_loss", "background_loss", "score"])

    id_type = dict(chunks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    schema = f"`{id_col}` {id_type}, n_tokens long, target_loss double, background_loss double, score double"
    return chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, schema)


def different_words(chunks: DataFrame) -> int:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unsqueezed(names).decode().split(), pa.string())], ["w"])

    return chunks.select("names").mapInArrow(run, "w string").distinct().count()


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, target_loss, background_loss, score) for every row of docs.

    target_ids: ids (column id_col) of the documents that the target model is counted from; the
    background model is counted from all others, and neither from the row that is scored. Losses are
    nats a token, score their difference; the first word of a text is told by its unigram. A text
    without words (null, empty) has 0 tokens and zeros. Null ids are scored and belong to the
    background. Repeated rows each count and get their row; repeated target ids count once. Columns
    beside those named are ignored. Texts of any length are read whole. All words and bigrams count,
    however many there are.
    """
    chosen = target_ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    chunks = stored(packed(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))), "lm-chunks")
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "size")).alias("at", "d")).select("chunk", "at", F.col("d.ids").alias("id"), F.col("d.size").alias("size"))
    flags = cut(rows.join(chosen.hint("merge"), "id").groupBy("chunk").agg(F.collect_list("at").alias("chosen"), F.sum("size").alias("tokens")))
    n_tokens = [df.agg(F.sum(c)).first()[0] or 0 for df, c in ((flags, "tokens"), (rows, "size"))]
    buckets = max(BUCKETS, chunks.count() // 8)
    # both steps read the same columns, so that the chunks are shuffled once for both
    flagged = chunks.join(flags.drop("tokens"), "chunk", "left").select("chunk", "ids", "size", "words", "names", "chosen")
    return scored(flagged, gram_totals(gram_counts(flagged, buckets)), id_col, (n_tokens[0], n_tokens[1]), different_words(chunks) + 1, buckets)
