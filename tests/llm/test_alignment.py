"""Cross-tokenizer alignment against the libraries by whole texts and a count by hand."""

import collections
import hashlib
import json
import random

import pytest

from chronoloom.llm import alignment
from chronoloom.llm.tokens import byte_letters

DOCS = "doc_id long, text string, n_a string, docs int"
SIGNS = [*"abcé' .,!?\n\t\r\x1c　ß9_<>|s中🙂\x00-;{}()", "  ", "'s", "</s>", "<|endoftext|>", "<unk>", "foo", "The", "http://", "\r\n"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 50))) for _ in range(400)]
    texts += [" ".join(rng.choice(["the", "wordcraft,", "Zürich", "x2y"]) for _ in range(60)) for _ in range(30)] + [texts[0]] * 3
    texts += [None, "", " ", "  ", "\n", " a", "a ", "a▁b", "é" * 300, "🙂中" * 200, "the word " * 20_000]
    return [*((i, t, "clash", 1) for i, t in enumerate(texts)), (3, "again one id", "x", 2), (None, "no id", None, None)]


def brute(rows):
    """Groups by whole texts from both libraries, counts by dictionaries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = alignment._paths(None, None)
    first, second = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    first.encode_special_tokens = True
    letters = {chr(c): b for b, c in byte_letters().items()}
    names = {i: bytes(letters[c] for c in p) for p, i in json.load(open(a_path))["model"]["vocab"].items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    found, held = [], collections.Counter()
    for _, text, *_ in rows:
        raw, groups = (" " + (text or "")).encode(), []
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        one, other = [names[i] for i in a], [piece(i) for i in b]
        if text and b"".join(one) == raw == b"".join(other):
            i = j = x = y = 0
            start = (0, 0)
            while i < len(a):
                x, i = x + len(one[i]), i + 1
                while y < x:
                    y, j = y + len(other[j]), j + 1
                if x == y:
                    groups.append((a[start[0] : i], b[start[1] : j]))
                    start = i, j
        links = collections.Counter((p, q) for g, h in groups for p in g for q in h)
        held.update(links.keys())
        found.append((groups, links))
    best = collections.defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for (doc_id, *_), (groups, links) in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        good = sum(n for k, n in links.items() if held[k] == best[k[0]])
        total = sum(n * held[k] for k, n in links.items())
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()), good, total, hashlib.sha256(text.encode()).hexdigest() if groups else "", text or None))
    every = collections.Counter()
    for _, links in found:
        every.update(links)
    return out, {k: (n, every[k]) for k, n in held.items()}


def test_alignment_equals_libraries_by_whole_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(alignment, "LEAST", 1 << 12)  # several units and buckets
    monkeypatch.setattr(alignment, "MOST", 1 << 14)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want, pairs = brute(rows)
    key = lambda r: (r[0] is None, r)
    got = [tuple(r) for r in alignment.align(docs).collect()]
    assert sorted(got, key=key) == sorted([r[:8] for r in want], key=key)
    assert {(r.a_id, r.b_id): (r.docs, r.links) for r in alignment.pair_counts(docs).collect()} == pairs
    assert collections.Counter((r.doc_id, r.groups) for r in alignment.groups(docs).collect()) == collections.Counter((r[0], r[8]) for r in want)


def test_bitmaps_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 40 * 300, 4000))
    pair, doc = np.divmod(key, 300)
    pair = pair.astype(np.uint64)
    keep = (pair < 10) | (doc % 50 == 0)  # dense and sparse pairs
    pair, doc = pair[keep], doc[keep]
    times = rng.integers(1, 70_000, len(pair))
    pairs, held, docs, many = alignment.postings(alignment.bitmaps(pair, doc, times, 300))
    assert np.repeat(pairs, held).tolist() == pair.tolist() and docs.tolist() == doc.tolist() and many.tolist() == times.tolist()


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert alignment.align(empty).collect() == [] and alignment.pair_counts(empty).collect() == []


def test_cut_stretches_join_to_the_text(rows):
    made = alignment.aligner(*alignment._paths(None, None))
    for _, text, *_ in rows:
        if text:
            assert "".join(" " + s for s in made.cut(text)) == " " + text
