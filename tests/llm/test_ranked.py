import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tissueframe.llm import ranked


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    own = [(k, Counter(terms(t)), len(terms(t))) for k, t in docs]
    n, total = sum(1 for *_, c in own if c), sum(c for *_, c in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for k, t in items:
        asked.setdefault(k, Counter()).update(terms(t))
    out = []
    for item, q in asked.items():
        scores = []
        for k, c, length in own:
            m = 75 + (25 * length * n) // max(total, 1)
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if c[t])
            if s > 0:
                scores.append((-s, k is None, k))
        out += [(item, r + 1, k, -s) for r, (s, _, k) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)] + ["Ñandú", "日本", "x9", "don't", "a_b"]
    weight = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(rng.randrange(10 * n), " ".join(rng.choices(vocab, weight, k=rng.choice([0, 1, 3, 20, 90])))) for _ in range(n)]
    docs += [docs[5]] * 3 + [(100_000 + i, "w3 w7 w11 w90") for i in range(60)] + [(None, "w3 w7 w11 w90"), (7_000, None), (7_001, "-- ..")]
    items = [(i, " ".join(rng.choices(vocab, weight, k=rng.choice([1, 4, 30])))) for i in range(12)]
    return docs, items + [(50, None), (51, "unheard"), (3, "w90 W90"), (52, "w3, w7! w11 w90 w90"), (None, "w5")]


@pytest.mark.parametrize(("seed", "parts", "top", "block"), [(1, 1, 20, 1 << 20), (2, 10, 5, 1 << 20), (3, 3, 20, 30)])
def test_equals_scoring_of_all(spark, monkeypatch, seed, parts, top, block):
    rows, items = corpus(seed, 400)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    got = ranked.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string"), top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, items, top)


@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_best_first_equals_full_scores(monkeypatch, leaf):
    monkeypatch.setattr(ranked, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    for _ in range(60):
        docs, lists = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        held = rng.random((lists, docs)) < rng.random()
        impact = np.where(held, rng.integers(0, 6, (lists, docs)), 0)
        where = np.nonzero(held)
        ranges = ranked.Ranges(where[0] * 3, where[1], impact[where], docs)
        asked, repeats = rng.choice(lists + 2, min(lists, 5), replace=False), rng.integers(1, 4, min(lists, 5))
        full = sum((impact[t] * r for t, r in zip(asked, repeats) if t < lists), np.zeros(docs, np.int64))
        want = sorted(((int(s), d) for d, s in enumerate(full) if s > 0), key=lambda x: (-x[0], x[1]))[:10]
        assert ranked.search_segment(ranges, asked * 3, repeats, 10) == want


def test_search_leaves_most_intervals_closed(monkeypatch):
    """One document of many stands out: few intervals are opened."""
    rng = np.random.default_rng(0)
    impact = rng.integers(1, 10, (5, 20_000))
    impact[:, 12_345] = 1000
    ranges = ranked.Ranges(np.repeat(np.arange(5), 20_000), np.tile(np.arange(20_000), 5), impact.ravel(), 20_000)
    asked = []
    best = ranges.best
    monkeypatch.setattr(ranges, "best", lambda a, b: asked.append(len(a)) or best(a, b))
    assert ranked.search_segment(ranges, np.arange(5), np.ones(5, np.int64), 1) == [(5000, 12_345)]
    assert sum(asked) < 10


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "alpha beta", 3), (2, "beta", 4), (3, "gamma " * 100_000, 5), (4, "delta", 6)], "doc_id int, text string, item int")
    items = spark.createDataFrame([(9, "Beta", "x")], "item_id int, text string, term string")
    assert [tuple(r)[:3] for r in ranked.search(docs, items).orderBy("rank").collect()] == [(9, 1, 1), (9, 2, 2)]
    assert ranked.search(docs.limit(0), items).count() == 0 and ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(docs.withColumn("text", docs["text"].substr(1, 0)), items).count() == 0
