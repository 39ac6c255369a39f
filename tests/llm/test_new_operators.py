"""Hard negatives, periodic runs and suffix deduplication against plain versions and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.llm import negatives, runs, suffixes

# ---- hard negatives ------------------------------------------------------------------------


def mined(rows, is_anchor, positives=5, wanted=3, low=50, high=95, scale=256):
    """Of (id, label, vector) with plain integers, sorts and loops."""
    limit = (1 << 63) - 1
    own = []
    for i, label, v in rows:
        with np.errstate(over="ignore"):
            if i is None or label is None or v is None or any(c is None or not np.isfinite(scale * np.float64(c)) for c in v):
                continue
        own.append((i, label, [int(np.floor(scale * np.float64(c))) for c in v]))
    out = Counter()
    for i, label, v in own:
        if not is_anchor(i):
            continue
        score = lambda w, v=v: max(-limit, min(limit, sum(a * b for a, b in zip(v, w, strict=True))))
        others = [(-score(w), j, k == label) for j, k, w in own if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in others if x[2])[:positives]:
            fits = sorted(x for x in others if not x[2] and low * -s <= 100 * -x[0] <= high * -s)
            for rank, (t, k, _) in enumerate(fits[:wanted], 1):
                out[i, j, rank, k, -s, -t] += 1
    return out


VECTORS = "vec_id long, embedding array<double>, label string, anchor long, win int, rank int"


def negatives_of(spark, vectors, **options):
    df = spark.createDataFrame([(i, v, label, 1, 2, 3) for i, label, v in vectors], VECTORS).repartition(3)
    return Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_against_sorting(spark):
    r = random.Random(3)
    rows = [(i, r.choice("abc"), [r.gauss(0.2, 0.3) for _ in range(6)]) for i in range(-40, 160)]
    rows += [(200 + i, r.choice("ab"), [0.5] * 6) for i in range(120)]  # ties without end, divided by id
    rows += [(None, "a", [0.5] * 6), (400, None, [0.5] * 6), (405, "a", None), (410, "a", [0.5, None, 0.0, 0.0, 0.0, 0.0]), (415, "a", [float("nan")] * 6), (420, "b", [float("inf")] + [0.0] * 5)]
    rows += [(425, "a", []), (426, "a", []), (430, "a", [0.1, 0.2]), (431, "a", [0.2, 0.2]), (432, "b", [0.1, 0.2]), (435, "a", [0.0] * 6)]
    rows += [(5, "a", [0.3] * 6), (5, "a", [0.3] * 6), (7, "c", [0.2] * 6), (7, "c", [0.2] * 6), (440, "b", [1e3] * 6), (441, "b", [-1e3] * 6)]
    want = mined(rows, lambda i: i % 5 == 0)
    assert len(want) > 300
    assert negatives_of(spark, rows, rows=64, anchors=16) == want
    assert negatives_of(spark, rows, positives=2, negatives=7, low=20, high=80) == mined(rows, lambda i: i % 5 == 0, 2, 7, 20, 80)


def test_hard_negatives_of_huge_components(spark):
    rows = [(5, "a", [1e12, 3.0]), (6, "a", [1e12, 7.0]), (7, "b", [9e11, 1.0]), (8, "b", [6e11, 2.0]), (9, "b", [1e300, 2.0]), (10, "a", [1e306, 2.0]), (11, "b", [1e5, 0.0]), (12, "a", [2e5, 0.0])]
    assert negatives_of(spark, rows) == mined(rows, lambda i: i % 5 == 0)


def test_hard_negatives_of_nothing(spark):
    assert not negatives_of(spark, [])
    assert not negatives_of(spark, [(5, "a", [1.0])])
    assert not negatives_of(spark, [(6, "a", [1.0]), (7, "b", [1.0])])


# ---- periodic runs -------------------------------------------------------------------------


def runs_of(x, least, periods):
    """Every maximal stretch x[i] == x[i + q], for every q; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(x) // periods + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def repeating(r):
    letters = r.choice([1, 2, 2, 3, 5])
    x = [r.randrange(letters) for _ in range(r.randint(0, 60))]
    if r.random() < 0.6:
        part = [r.randrange(letters) for _ in range(r.randint(1, 9))] * r.randint(1, 6)
        x = x[: len(x) // 2] + part[: r.randint(0, len(part))] + x[len(x) // 2 :]
    if r.random() < 0.5:
        x += x[r.randint(0, len(x)) :] * r.randint(1, 4)
    return x + x if r.random() < 0.3 else x


def test_runs_against_all_periods():
    r = random.Random(1)
    for _ in range(600):
        x = repeating(r)
        for least, periods in ((1, 2), (4, 2), (6, 3), (24, 3)):
            assert runs.runs(x, least, periods) == runs_of(x, least, periods), x


def test_factors_are_the_longest_that_occur_before():
    r = random.Random(2)
    for _ in range(200):
        x = repeating(r)[:80]
        at = 0
        for a, b, earlier in runs.factors(x):
            assert a == at and (earlier < 0 and b == a + 1 and x[a] not in x[:a] or 0 <= earlier < a and x[earlier : earlier + b - a] == x[a:b])
            assert b == len(x) or earlier < 0 or not any(x[k : k + b + 1 - a] == x[a : b + 1] for k in range(a))
            at = b
        assert at == len(x)


def digest_of(doc_id, words):
    found = runs_of(words, 24, 3)
    kept = [True] * len(words)
    for s, e, q in found:
        kept[s + q : e] = [False] * (e - s - q)
    best = max(found, key=lambda f: (Fraction(f[1] - f[0], f[2]), -f[0], -f[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    at = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *at, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(w for w, k in zip(words, kept, strict=True) if k)))


def test_periodic_runs_of_documents(spark):
    r = random.Random(4)
    some = ["a", "bb", "c'", "ñ", " ", "\U0001f600x"]
    texts = [None, "", " \n\t ", "a " * 23, "a " * 24, "\x0ba\x0c" * 40, "one two " * 400, "x y " * 30, "a b c d e f g h i j k l " * 3 + "z"]
    texts += ["\n".join(some[k] for k in repeating(r)) for _ in range(80)]
    long_ = [str(r.randrange(2_000)) for _ in range(9_000)]
    texts.append(" ".join(long_ + long_[3_000:] * 4 + long_[:100] + ["q", "r"] * 500))
    rows = [(k if k % 7 else None, t, "x", 1, [2]) for k, t in enumerate(texts)] + [(1, "a b " * 20, "x", 1, [2])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, h int, words array<int>")
    want = Counter(digest_of(i, [w for w in re.split("[ \t-\r]+", t or "") if w]) for i, t, *_ in rows)
    got = runs.digests(runs.periodic_runs(df))
    assert Counter(tuple(x) for x in got.collect()) == want
    assert sum(x[1] for x in want) > 40
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert runs.digests(runs.periodic_runs(df.limit(0))).count() == 0


def test_repeats_are_put_in(spark):
    texts = {k: " ".join(f"w{j}" for j in range(k % 90)) for k in range(300)}
    rows = [(k, t, "h", 1) for k, t in texts.items()] + [(None, "a b c", "h", 1), (1000, None, "h", 1)]
    got = runs.with_repeats(spark.createDataFrame(rows, "doc_id long, text string, h string, words int"))
    assert got.columns == ["doc_id", "text", "h", "words"]
    changed = 0
    for row in got.collect():
        if row["doc_id"] is None or row["doc_id"] == 1000:
            assert row["text"] == ("a b c" if row["doc_id"] is None else None)
            continue
        h, words = zlib.crc32(str(row["doc_id"]).encode()), texts[row["doc_id"]].split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            changed += 1
        assert row["text"].split() == words
    assert changed > 10


# ---- suffix deduplication ------------------------------------------------------------------


def removed(rows, least=50):
    """By a dictionary of all strings of least bytes."""
    key = lambda i: float("inf") if i is None else i
    first: dict[bytes, float] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - least + 1):
            first[t[k : k + least]] = min(key(i), first.get(t[k : k + least], float("inf")))
    out = Counter()
    for i, t in texts:
        gone = [False] * (len(t) + 1)
        for k in range(len(t) - least + 1):
            if first[t[k : k + least]] < key(i):
                gone[k : k + least] = [True] * least
        edge = [k for k in range(len(t) + 1) if gone[k] != (gone[k - 1] if k else False)]
        out[i, len(t), tuple(zip(edge[::2], edge[1::2], strict=True)), bytes(c for c, g in zip(t, gone, strict=False) if not g)] += 1
    return out


@pytest.fixture(scope="module")
def passages():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    shared = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(12)]
    rows = []
    for k in range(90):
        parts = [" ".join(word() for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            parts += [p[r.randint(0, 20) :], " ".join(word() for _ in range(r.randint(0, 10)))]
        rows.append((r.randrange(10**6) - 500_000, "".join(parts)))
    rows += [(None, shared[0]), (None, shared[0]), (3, None), (4, ""), (5, "x" * 49), (6, "x" * 50), (7, "x" * 5_000), (8, "ab" * 900 + "x" * 60), (8, "ab" * 900), (9, "\0" * 70), (10, "\0" * 60 + "\x01")]
    rows += [(11, "é" * 25 + "z"), (12, "y" + "é" * 25), (13, "\U0001f600" * 40), (14, "\U0001f600" * 13), (7, "x" * 5_000)]
    rows += [(1_000_000 + k, shared[1] + shared[2]) for k in range(30)] + [(2_000_000, rows[0][1] * 2), (2_000_001, "the end"), (2_000_001, "the end")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_repeats_removed_against_a_dictionary(spark, passages, monkeypatch, hot):
    want = removed(passages)
    assert sum(len(x[2]) for x in want) > 60
    df = spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in passages], "doc_id long, text string, id string, chunk int, data binary").repartition(5)
    got = Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in suffixes.repeats_removed(df, hot=hot).collect())
    assert got == want


def test_repeats_removed_across_blocks(spark, passages, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    text = np.frombuffer("".join(t or "" for _, t in passages).encode(), np.uint8)
    size = np.array([len((t or "").encode()) for _, t in passages])
    first, n, key, doc = suffixes.pieces(text, size)
    ends = np.cumsum(size)
    whole = [k for e, s in zip(ends, size, strict=True) for k in range(e - s, e - suffixes.LEAST + 1)]
    assert [k for f, m in zip(first, n, strict=True) for k in range(f, f + m)] == whole
    assert all(ends[d] - size[d] <= f and f + m + suffixes.LEAST - 1 <= ends[d] for f, m, d in zip(first, n, doc, strict=True))
    of: dict[bytes, set] = {}
    for f, m, k in zip(first, n, key, strict=True):
        for at in range(f, f + m):
            of.setdefault(text[at : at + suffixes.LEAST].tobytes(), set()).add(int(k))
    assert all(len(x) == 1 for x in of.values())


def test_borders_against_sorting():
    r = random.Random(6)
    for _ in range(60):
        strings = sorted({bytes(r.choice(b"ab\0c"[: r.randint(1, 4)]) for _ in range(r.randint(5, 30))) for _ in range(r.randint(1, 30))})
        least = 5
        size = np.array(list(map(len, strings)))
        doc = np.array([r.randrange(50) for _ in strings])
        got = suffixes.least_docs(np.frombuffer(b"".join(strings), np.uint8), size, doc, least)
        low: dict[bytes, int] = {}
        for s, d in zip(strings, doc.tolist(), strict=True):
            for k in range(len(s) - least + 1):
                low[s[k : k + least]] = min(d, low.get(s[k : k + least], d))
        assert got.tolist() == [low[s[k : k + least]] for s in strings for k in range(len(s) - least + 1)]


def test_repeats_removed_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.digests(suffixes.repeats_removed(empty)).count() == 0
    only = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in suffixes.digests(suffixes.repeats_removed(only)).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0)]
