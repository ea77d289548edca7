"""Jaccard join against all pairs, at production and at tiny group sizes."""

import random
import re

import numpy as np
import pytest

from chronoloom.llm import jaccard, stars

DOCS = "doc_id long, text string, n_shingles string, kept int"
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def brute(rows, width, percent):
    sets = []
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, other, line = prose(150), prose(80), prose(12)
    texts = []
    for source, n in ((base, 60), (other, 30)):  # near copies, some linked with each other only by others
        for _ in range(n):
            words = source.split()
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts += [base] * 15 + [line + " " + prose(rng.randrange(1, 4)) for _ in range(40)] + [prose(40) for _ in range(20)]
    texts += [None, "", " \t\n", "one", "ONE", "one two", "One  two", "a b c", "a b c d", "...", "Größe ßtraße É", prose(20_000)]
    out = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return [*out, out[3], (5, texts[70], "c", 0), (None, base, "c", 1), (None, prose(9), "c", 1), (None, None, None, None)]


@pytest.mark.parametrize("tiny", [False, True])
def test_join_equals_all_pairs(spark, rows, monkeypatch, tiny):
    if tiny:  # broadcast groups, leaders in several tasks, blocks of a few rows, several units and buckets
        for module, name, value in ((stars, "HOT", 2), (stars, "BLOCK", 3), (jaccard, "LEAST", 1 << 10), (jaccard, "MOST", 1 << 12)):
            monkeypatch.setattr(module, name, value)
    got = jaccard.join(spark.createDataFrame(rows, DOCS).repartition(3), 3, 90).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(brute(rows, 3, 90), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) or r.component_id is None for r in got)


def test_linked_sets_share_prefix_tokens_under_every_order():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, percent = int(rng.integers(1, 60)), int(rng.integers(50, 101))
        pool = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
        level = {int(t): int(v) for t, v in zip(pool, rng.integers(2, 6, len(pool)), strict=True)}
        a = np.sort(rng.choice(pool, n, replace=False))
        b = np.unique(np.concatenate([a[rng.random(n) < 0.95], rng.choice(pool, 2)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            of = lambda s: jaccard.prefixes(s, np.array([level[int(t)] for t in s], np.uint8), percent)  # noqa: E731,B023
            x, y = of(a), of(b)
            assert all(len(np.intersect1d(p, q)) for p, q in zip(x, y, strict=True))
            one, other = jaccard._filter(len(a), x), jaccard._filter(len(b), y)
            keys = np.intersect1d(x[0], y[0]).view(np.int64).tolist()
            assert jaccard._sharing(percent)([other] * 2, None)(one).all()
            assert [bool(jaccard._sharing(percent)([other], k)(one)[0]) for k in keys] == [True] + [False] * (len(keys) - 1)


def test_filters_that_share_too_little_are_told():
    tokens = [np.arange(k, k + 10, dtype=np.uint64) << np.uint64(32) for k in (0, 5, 8, 20)]
    one, *others = (jaccard._filter(100, [t] * jaccard.ORDERS) for t in tokens)
    # of 100 tokens each, 95 have to be shared, and at most 89 are beyond a prefix
    assert jaccard._sharing(90)([one, *others], None)(one).tolist() == [True, False, False, False]
    small = jaccard._filter(90, [tokens[2]] * jaccard.ORDERS)  # 90 have to be shared: one more than may be beyond
    assert jaccard._sharing(90)([small], None)(one).tolist() == [True]


def test_no_documents(spark):
    assert jaccard.join(spark.createDataFrame([], DOCS)).collect() == []
