"""Log-odds, the extreme-value law, evidence and probability of toxicity against plain versions."""

import math
import random
from collections import Counter

import numpy as np

from orograph.llm import toxicity

WORDS = "the of and to in is that for it as was with be by on not vileness vilest vilely rottenly rotten rottens abc abcdef abcdeg".split()


def labelled(n: int = 120):
    r = random.Random(9)
    rows = []
    for k in range(n):
        y = int(r.random() < 0.4)
        words = [r.choice(WORDS[:16]) if r.random() > (0.3 if y else 0.02) else r.choice(WORDS[16:]) for _ in range(r.randint(5, 60))]
        rows.append((" ".join(words), y, k % 3))
    return rows


def odds_of(rows):
    t, c = Counter(), Counter()
    for text, y, _ in rows:
        (t if y else c).update(toxicity.tokens(text))
    total_t, total_c = sum(t.values()), sum(c.values())
    base = total_t / (total_t + total_c)

    def shrunk(a, b, rate, strength):
        a, b = a + rate * strength, b + (1 - rate) * strength
        odds = math.log(a / total_t) - math.log(b / total_c)
        return max(-toxicity.MOST, min(toxicity.MOST, odds)), abs(odds) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), a / (a + b)

    words = t.keys() | c.keys()
    stems = {s: shrunk(sum(t[w] for w in words if w[:5] == s), sum(c[w] for w in words if w[:5] == s), base, toxicity.PRIOR_STEM) for s in {w[:5] for w in words}}
    tokens = {}
    for w in words:
        odds, z, _ = shrunk(t[w], c[w], stems[w[:5]][2], toxicity.PRIOR_TOKEN)
        if z >= toxicity.LEAST_Z:
            tokens[w] = odds
        elif stems[w[:5]][1] >= toxicity.LEAST_Z:
            tokens[w] = 0.0
    return tokens, {s: x[0] for s, x in stems.items() if x[1] >= toxicity.LEAST_Z and len(s) == 5}


def same(a: dict, b: dict) -> bool:
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def law_of(texts, tokens, stems):
    """(lambda, K, what each text gives) by plain sums."""
    score = lambda w: tokens.get(w, stems.get(w[:5], 0.0) if len(w) > 5 else 0.0) - toxicity.DRIFT
    of = [([score(w) for w in toxicity.tokens(t)], y) for t, y, _ in texts]
    clean = [round(s, 3) for x, y in of if not y for s in x]
    f = lambda lam: sum(math.exp(lam * s) for s in clean) / len(clean)
    low, high = 1e-6, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    best = [(max(sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), len(x)) for x, y in of if not y and max(x) > 0]
    k = math.exp(sum(low * m - math.log(n) for m, n in best) / len(best) - toxicity.EULER)
    return low, min(max(k, 1e-6), 10.0), of


def test_statistics_of_a_small_table(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "text string, y int, part int").repartition(4)
    model = toxicity.train(df)
    tokens, stems = odds_of(rows)
    assert len(tokens) > 6 and stems
    assert same(model.tokens, tokens) and same(model.stems, stems)
    laws, seen = [], []
    for p in range(toxicity.PARTS):
        own, of_stems = odds_of([r for r in rows if r[2] != p])
        lam, k, of = law_of([r for r in rows if r[2] == p], own, of_stems)
        laws.append((lam, k))
        law = toxicity.Model(lam=lam, k=k)
        for x, y in of:
            found = toxicity.segments(np.array(x))
            over = sorted((lam * s - math.log(k * len(x)) for _, _, s in found), reverse=True)
            assert toxicity.weighed([s for _, _, s in found], len(x), law) == ((over[0], sum(v for v in over[1:] if v >= -math.log(0.01))) if over else (-10.0, 0.0))
            seen.append((y, over[0] if over else -10.0, sum(v for v in over[1:] if v >= -math.log(0.01))))
    assert math.isclose(model.lam, math.exp(sum(math.log(x) for x, _ in laws) / 3), rel_tol=1e-6)
    assert math.isclose(model.k, math.exp(sum(math.log(x) for _, x in laws) / 3), rel_tol=1e-4)
    x = np.array(seen, float)
    assert np.allclose(model.weights, toxicity.logistic(toxicity.features(x[:, 1], x[:, 2]), x[:, 0]), rtol=1e-3, atol=1e-3)
    # and the score of a text
    texts = [r[0] for r in rows[:20]] + ["", None, "12 !?"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    for r in got:
        words = toxicity.tokens(texts[r["doc_id"]] or "")
        s = [tokens.get(w, stems.get(w[:5], 0.0) if len(w) > 5 else 0.0) - toxicity.DRIFT for w in words]
        over = sorted((model.lam * v - math.log(model.k * max(1, len(s))) for _, _, v in toxicity.segments(np.array(s))), reverse=True) if s else []
        z = model.weights[0] + model.weights[1] * min(40, max(-10, over[0] if over else -10.0)) + model.weights[2] * math.log1p(max(0.0, sum(v for v in over[1:] if v >= -math.log(0.01))))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6) and r["predicted"] == int(r["score"] >= 0.3)


def test_rows_with_both_labels_are_toxic(spark):
    docs = spark.createDataFrame([(1, "foul words"), (2, "foul words"), (3, "fair words"), (3, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    seen = {}
    held, toxicity_train = toxicity.train, toxicity.train
    try:
        toxicity.train = lambda rows: seen.update({r["text"]: r["y"] for r in rows.collect()})
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = toxicity_train
    assert held is toxicity.train and seen == {"foul words": 1, "fair words": 1, "other words": 1}
