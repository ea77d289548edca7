"""Ranked lexical search against a plain loop over all documents."""

import collections
import math
import random
import re

import numpy as np
import pytest

from chronoloom.llm import lexical

DOCS = "doc_id long, text string, score string, rank int"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    found = [(i, terms(t)) for i, t, *_ in docs]
    n, length = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    df = collections.Counter(x for _, t in found for x in set(t))
    asked = collections.defaultdict(set)
    for i, t, *_ in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for doc_id, t in found:
            tf, m = collections.Counter(t), 10 + 90 * len(t) * n // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in words if tf[x])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        scored.sort()
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["Größe", "ÄÖ", "x1", "X1"]
    weigh = [1 / (i + 1) for i in range(len(words))]
    some = lambda n: " ".join(rng.choices(words, weigh, k=n))
    docs = [(i, some(rng.randrange(1, 120)), "c", 1) for i in range(300)]
    docs += [(300 + i, docs[5][1], "c", 1) for i in range(40)] + [(400, "w9 " * 30_000, "c", 1), (401, None, None, None), (402, "", "c", 1), (403, "... --", "c", 1)]
    docs += [docs[7], (None, docs[5][1], "c", 1), (None, None, None, None)]
    items = [(i, some(rng.randrange(1, 15)), "x") for i in range(25)] + [(30, docs[5][1], "x"), (31, None, "x"), (32, "", "x"), (33, "nowhere", "x"), (34, "w1", "x"), (34, "w2 w1", "x"), (None, "w3", "x")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_loop(spark, tables, monkeypatch, small):
    docs, items = tables
    if small:  # several units, blocks of items and batches
        for name, value in (("LEAST", 1 << 10), ("MOST", 1 << 12), ("TERMS", 60), ("BATCH", 1 << 10), ("STEP", 2)):
            monkeypatch.setattr(lexical, name, value)
    made = lexical.index(spark.createDataFrame(docs, DOCS).repartition(3))
    got = lexical.search(made, spark.createDataFrame(items, ITEMS), 5).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, 5), key=key)


def test_bounds_are_above_scores(spark, tables):
    docs, items = tables
    for row in lexical.index(spark.createDataFrame(docs, DOCS).coalesce(1)).collect():
        unit = lexical.Unit(bytes(row.blob))
        hashes, found = lexical.terms([(t or "").encode() for _, t, _ in items])
        asked = [unit.known(np.sort(hashes[np.unique(f)])) for f in found]
        bounds = unit.bounds(asked)
        every = np.arange(len(unit.ids))
        for q, bound in zip(asked, bounds, strict=True):
            score = unit.scores(q, every) if len(q) else np.zeros(len(every), np.int64)
            assert (bound >= score).all()


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", "", 1)], DOCS)
    asked = spark.createDataFrame([(1, "a", "")], ITEMS)
    for docs, items in ((none, asked), (some, no_items), (none, no_items)):
        found = lexical.search(lexical.index(docs), items)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []
    assert [tuple(r)[:3] for r in lexical.search(lexical.index(some), asked).collect()] == [(1, 1, 1)]


def test_lengths_beyond_64_bits():
    tf, n = np.array([1, 10**6]), np.array([10**9, 10**9])
    got = lexical.saturated(tf, n, 10**12, 10**15)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * 10**9 * 10**12 // 10**15)) for t in (1, 10**6)]
