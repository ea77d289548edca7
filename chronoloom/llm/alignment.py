"""Alignment of two tokenizers over whole texts, with inverted pair bitmaps.

A text with a space before it is encoded by both tokenizers. Byte offsets where a token of each ends cut it into groups;
every A token of a group is linked with every B token of it. How many documents of the corpus hold a pair of ids linked
comes from bitmaps:

1. Texts are cut into stretches before spaces, where neither tokenizer joins what stands on both sides (B's vocabulary
   is searched for pieces that would). Stretches repeat, so groups and links of a stretch are made once and remembered.
   Texts with signs that the two take for different kinds of white space are encoded as a whole.
2. A unit of documents holds, for each pair of ids, a compressed bitmap of its documents (a list of numbers where few
   have the pair) and planes of the multiplicity's bits: a document's link count, read plane by plane.
3. Units have different documents, so the OR of their bitmaps has as many bits as all have together. Each unit
   therefore popcounts its bitmaps (and weighs the planes' counts by 2**plane for link counts) and sends the counts;
   buckets of pairs add them up. No bitmap moves, and a pair that all documents hold costs a bucket one entry a unit.
4. Of each A id, the highest count is kept: a vector as long as A's vocabulary, the only thing that reaches the driver.
5. Counts go back to the units' postings, whose documents add them up.

Documents are rows: a row that repeats a doc_id, or has a null one, is a document of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import units as U
from .common import deltas, materialize, mix, pack, read, slim, tune, unpack
from .tokens import byte_letters

MEMO = 500_000  # stretches remembered by a worker; the memo is emptied beyond that
LEAST, MOST = 4 << 20, 12 << 20  # bytes of text of a unit
DENSE = 16  # a pair that a unit's documents hold more often than one in so many has a bitmap, not a list
COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


class Encoders:
    """Both tokenizers, by stretches that begin with their space: ids, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        letters = {chr(c): b for b, c in byte_letters().items()}
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if all(c in letters for c in piece)}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        made = [vocabulary["".join(m)] for m in merges]
        self.a = self._by_ranks(ranks) if made == sorted(made) else self._by_file(a_path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # the space is part of what is encoded here
        self.b = SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece for p in model.pieces]
        hexes = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in pieces]
        self.b_bytes = [bytes([int(h[1], 16)]) if h else p.replace("▁", " ").encode() for p, h in zip(pieces, hexes, strict=True)]
        #: no piece of B goes on over a space
        self.cuts = not any(y == "▁" and x != "▁" for p, h in zip(pieces, hexes, strict=True) if not h for x, y in zip(p, p[1:], strict=False))

    def _by_ranks(self, ranks: dict[bytes, int]):
        """Merges in order of ids are what byte ranks say, too; that library is the faster one for short texts."""
        import public_tokenizers
        import tiktoken

        core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [core.encode_ordinary(t) for t in texts]

    def _by_file(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return self.a(texts), self.b.encode(texts, num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and the list of each."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), np.repeat(np.arange(len(lists)), size)


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their times."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[at], np.add.reduceat(times[order], at) if len(at) else times[:0]


class Aligner:
    """Stretches of a worker and what is known of them: counts, groups as text, links as pairs with multiplicities."""

    def __init__(self, a_path: str, b_path: str):
        self.encoders = e = Encoders(a_path, b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (e.a_bytes, e.b_bytes))
        # ids as text with what follows them: A in a group and at its end, B in a group, at its end and at the stretch's
        self.words = [str(i).encode() + end for names, ends in ((e.a_bytes, (b",", b"|")), (e.b_bytes, (b",", b";", b""))) for end in ends for i in range(len(names))]
        self.uneven = re.compile(r" (?:\s|\Z)")
        #: a stretch ends before a space that follows other than white space
        self.stretch = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
        self.whole = re.compile("[▁\x1c-\x1f]")  # B's own blank, and signs that are white space only to Python
        self.empty()

    def empty(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[bytes | None] = []  # None: bytes differ
        self.counts = np.empty((0, 4), np.int64)
        self.ends = np.zeros(1, np.int64)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, stretches: list[str]) -> None:
        e, n = self.encoders, len(stretches)
        one, other = e.encode(stretches)
        raw = [s.encode() for s in stretches]
        wrong = [b"".join([e.a_bytes[i] for i in a]) != r or b"".join([e.b_bytes[i] for i in b]) != r for a, b, r in zip(one, other, raw, strict=True)]
        one, other = ([[] if w else x for x, w in zip(ids, wrong, strict=True)] for ids in (one, other))
        (a, a_row), (b, b_row) = _flat(one), _flat(other)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])  # joined stretches: every stretch ends in both
        in_both = np.zeros(int(a_end[-1]) + 1 if len(a) else 1, np.int64)
        in_both[a_end] = 1
        in_both[b_end] += 1
        in_both >>= 1
        group = np.cumsum(in_both) - in_both  # common ends before a byte
        a_group, b_group, group_row = group[a_end], group[b_end], a_row[in_both[a_end] > 0]
        # links: distinct ids of a group by each other, so that a long group costs no more than its distinct pairs
        width = len(e.b_bytes)
        key, an = _summed(a_group * len(e.a_bytes) + a, np.ones(len(a), np.int64))
        ag, ai = np.divmod(key, len(e.a_bytes))
        key, bn = _summed(b_group * width + b, np.ones(len(b), np.int64))
        bg, bi = np.divmod(key, width)
        first, last = np.searchsorted(bg, ag), np.searchsorted(bg, ag, "right")
        size = last - first
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        span = len(e.a_bytes) * width
        key, times = _summed(group_row[np.repeat(ag, size)] * span + np.repeat(ai, size) * width + bi[at], np.repeat(an, size) * bn[at])
        row, pair = np.divmod(key, span)
        counts = np.stack([np.bincount(a_row, minlength=n), np.bincount(b_row, minlength=n), np.bincount(group_row, minlength=n), np.bincount(row, times, n).astype(np.int64)], axis=1)
        # groups as text
        ends = lambda g, r: (np.append(g[1:] != g[:-1], True)[: len(g)], np.append(r[1:] != r[:-1], True)[: len(r)])
        (a_last, _), (b_last, row_last) = ends(a_group, a_row), ends(b_group, b_row)
        word = np.concatenate([a + len(e.a_bytes) * a_last, 2 * len(e.a_bytes) + b + len(e.b_bytes) * (b_last.astype(np.int64) + (b_last & row_last))])
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a_group, b_group])))
        parts = [self.words[i] for i in word[order].tolist()]
        bounds = np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        self.text += [None if w else b"".join(parts[x:y]) for w, x, y in zip(wrong, [0, *bounds], bounds, strict=False)]
        self.counts = np.concatenate([self.counts, counts])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(row, minlength=n))])
        self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])

    def cut(self, text: str) -> list[str]:
        """A text's stretches without their spaces."""
        if not self.encoders.cuts or "▁" in text:
            return [text]
        full = " " + text
        if not self.uneven.search(full):
            return full.split(" ")[1:]
        return [text] if self.whole.search(full) else [s[1:] for s in self.stretch.findall(full)]

    def __call__(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Of each text, the numbers of its stretches; none for an empty one."""
        if len(self.known) > MEMO:
            self.empty()
        new: list[str] = []

        class Known(dict):
            def __missing__(me, stretch: str) -> int:
                new.append(" " + stretch)
                at = me[stretch] = len(me)
                return at

        known = self.known = Known(self.known)
        found = []
        for text in texts:
            cut = self.cut(text) if text else ()
            found.append(np.fromiter(map(known.__getitem__, cut), np.int64, len(cut)))
        for at in range(0, len(new), 50_000):
            self.add(new[at : at + 50_000])
        return found

    def groups(self, stretches: np.ndarray) -> bytes | None:
        """a1,a2|b1;a3|b2,b3 of a text; None where it has no tokens."""
        parts = [self.text[i] for i in stretches.tolist()]
        return b";".join(parts) if parts and None not in parts else None


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each pair of files and Python worker, so that its memo outlives a task."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def bitmaps(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> list[np.ndarray]:
    """Postings in order of (pair, doc) as vectors: pairs, documents of each, lists, bitmaps, planes of multiplicities."""
    pairs, first, held = np.unique(pair, return_index=True, return_counts=True)
    dense = np.repeat(held * DENSE > docs, held)
    row = np.repeat(np.cumsum(held * DENSE > docs) - 1, held)[dense]
    rows = int((held * DENSE > docs).sum())
    bits = np.zeros((rows, -(-docs // 8)), np.uint8)
    np.bitwise_or.at(bits, (row, doc[dense] >> 3), (1 << (doc[dense] & 7)).astype(np.uint8))
    planes = []
    while len(times) and (times >> len(planes)).any():
        planes.append(np.packbits((times >> len(planes) & 1).astype(bool)))
    return [deltas(pairs), slim(held), slim(doc[~dense]), bits.reshape(-1), np.array([docs, len(planes)], "<i8"), *planes]


def postings(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``bitmaps`` packed: pairs, documents of each (popcount), and of all postings document and multiplicity."""
    pairs, held, lists, bits, (docs, n), *planes = parts
    pairs, held = np.cumsum(pairs.astype(np.uint64), dtype=np.uint64), held.astype(np.int64)
    dense = held * DENSE > docs
    doc = np.empty(int(held.sum()), np.int64)
    which = np.repeat(dense, held)
    doc[~which] = lists
    doc[which] = np.nonzero(np.unpackbits(bits.reshape(int(dense.sum()), -(-int(docs) // 8)), axis=1, bitorder="little"))[1]
    times = np.zeros(len(doc), np.int64)
    for plane in range(int(n)):
        times += np.unpackbits(planes[plane], count=len(doc)).astype(np.int64) << plane
    return pairs, held, doc, times


def _encoded(a_path: str, b_path: str):
    def encoded(held: list[pa.RecordBatch]) -> bytes:
        made = aligner(a_path, b_path)
        texts = [t for batch in held for t in batch.column("a_text").to_pylist()]
        found = made(texts)
        size = np.array([len(f) for f in found], np.int64)
        stretch = np.concatenate([np.empty(0, np.int64), *found])
        digests = [hashlib.sha256(x).digest() if (x := made.groups(f)) is not None else b"" for f in found]
        fine = np.array([len(d) > 0 for d in digests], bool)
        doc = np.repeat(np.arange(len(found)), size)
        counts = np.zeros((len(found), 4), np.int64)
        for c in range(4):
            counts[:, c] = np.bincount(doc, made.counts[stretch, c], len(found)) * fine
        # links: distinct stretches of a document, their pairs, and these summed up by (pair, document)
        key, many = np.unique((doc * len(made.text) + stretch)[fine[doc]], return_counts=True)
        doc, stretch = np.divmod(key, max(1, len(made.text)))
        size = made.ends[stretch + 1] - made.ends[stretch]
        at = np.repeat(made.ends[stretch] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        key, times = _summed(made.pairs[at] * max(1, len(found)) + np.repeat(doc, size), np.repeat(many, size) * made.times[at])
        pair, doc = np.divmod(key, max(1, len(found)))
        ids = pa.chunked_array([batch.column("doc_id") for batch in held]).combine_chunks()
        return pack(
            ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), np.array(ids.is_null().to_numpy(zero_copy_only=False), "u1"), *(slim(c) for c in counts.T),
            fine.astype("u1"), np.frombuffer(b"".join(digests), np.uint8), *bitmaps(pair.astype(np.uint64), doc, times, len(found)),
        )

    return encoded


def _buckets(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return U.split((mix(pairs.copy()) % np.uint64(n)).astype(np.int64), n)


def _sent(n: int):
    """Popcounts of a unit's bitmaps and link counts by planes, by bucket of pairs."""

    def sent(unit: int, parts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        pairs, held, _, times = postings(parts[8:])
        links = np.add.reduceat(times, np.cumsum(held) - held) if len(held) else held
        order, bounds = _buckets(pairs, n)
        for bucket in np.flatnonzero(np.diff(bounds)).tolist():
            at = order[bounds[bucket] : bounds[bucket + 1]]
            yield bucket, pack(deltas(pairs[at]), slim(held[at]), slim(links[at]))

    return sent


def _added(blobs: list[bytes]) -> tuple[list[bytes | None], list[int], bytes]:
    """Corpus-wide counts of a bucket's pairs, back to each unit; about the bucket: pairs, documents and links."""
    got = [unpack(b) for b in blobs]
    got = [(np.cumsum(p.astype(np.uint64), dtype=np.uint64), d.astype(np.int64), n.astype(np.int64)) for p, d, n in got]
    pairs, place = np.unique(np.concatenate([p for p, _, _ in got]), return_inverse=True)
    docs, links = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    np.add.at(docs, place, np.concatenate([d for _, d, _ in got]))
    np.add.at(links, place, np.concatenate([n for _, _, n in got]))
    bounds = np.cumsum([0, *(len(p) for p, _, _ in got)])
    answers = [pack(slim(docs[place[a:b]])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return answers, [len(pairs)], pack(deltas(pairs), slim(docs), slim(links))


def _listed(width: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                pairs, docs, links = unpack(blob)
                columns = (*np.divmod(np.cumsum(pairs.astype(np.uint64), dtype=np.uint64), np.uint64(width)), docs, links)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a_id", "b_id", "docs", "links"])

    return listed


def _highest(width: int):
    """Of each bucket, the highest count of each A id."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _listed(width)(batches):
            a, docs = (batch.column(c).to_numpy() for c in ("a_id", "docs"))
            at = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])  # pairs come in order
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(np.maximum.reduceat(docs, at) if len(at) else docs)], ["a_id", "docs"])

    return highest


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(n: int, width: int, best: np.ndarray):
    def scored(unit: int, parts: list[np.ndarray], got: dict[tuple[int, int], bytes]) -> pa.Table:
        ids, none, n_a, n_b, n_groups, n_links, fine, digests = parts[:8]
        pairs, held, doc, times = postings(parts[8:])
        count = np.zeros(len(pairs), np.int64)
        order, bounds = _buckets(pairs, n)
        for (_, bucket), blob in got.items():
            count[order[bounds[bucket] : bounds[bucket + 1]]] = unpack(blob)[0]
        top = count == best[(pairs // np.uint64(width)).astype(np.int64)]
        total, good = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(total, doc, times * np.repeat(count, held))
        np.add.at(good, doc, times * np.repeat(top, held))
        hexes, at = [], 0
        for x in fine.tolist():
            hexes.append(digests[at : at + 32].tobytes().hex() if x else "")
            at += 32 * x
        numbers = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links, good, total)]
        return pa.table([pa.array(ids, mask=none.astype(bool)), *numbers, pa.array(hexes, pa.string())], ["doc_id", *COLUMNS, "n_best", "count_sum", "groups_sha256"])

    return scored


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def _counted(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame, int]:
    """Units of documents with their bitmaps, counts by bucket of pairs, and how many buckets."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("a_text"))
    text = U.text_of(rows, "a_text")
    made = U.units(rows, "a_text", U.side(text, LEAST, MOST), _encoded(a_path, b_path))
    n = U.buckets_for(text, U.side(text, LEAST, 16 * MOST))
    return made, materialize(U.meet(U.send(made, _sent(n), unpack), _added, 1)), n


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs(doc_id, text).

    n_best counts links whose pair is in as many documents as any pair of its A id; count_sum adds up the pairs'
    documents over links. A null or empty text, or one whose tokens' bytes differ from it, has zeros and ''."""
    a_path, b_path = _paths(a_path, b_path)
    made, answers, n = _counted(docs, a_path, b_path)
    encoders = Encoders(a_path, b_path)
    width, best = len(encoders.b_bytes), np.zeros(len(encoders.a_bytes), np.int64)
    highest = answers.where(F.col("unit").isNull()).select("blob").mapInArrow(_highest(width), "a_id long, docs long").groupBy("a_id").agg(F.max("docs").alias("docs"))
    for row in highest.toLocalIterator():  # at most a row for each entry of A's vocabulary
        best[row.a_id] = row.docs
    return U.back(made, answers.withColumn("kind", F.lit(0)), _scored(n, width, best), RESULT, unpack)


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a_id, b_id, docs (rows that hold the pair linked), links: every pair of ids that some document links."""
    a_path, b_path = _paths(a_path, b_path)
    _, answers, _ = _counted(docs, a_path, b_path)
    width = len(Encoders(a_path, b_path).b_bytes)
    return answers.where(F.col("unit").isNull()).select("blob").mapInArrow(_listed(width), "a_id long, b_id long, docs long, links long")


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, groups: each row's groups of ids as a1,a2|b1;a3|b2,b3; null where it has no tokens."""
    a_path, b_path = _paths(a_path, b_path)
    tune(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with_groups = aligner(a_path, b_path)
            found = [with_groups.groups(f) for f in with_groups(batch.column("a_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x and x.decode() for x in found], pa.string())], ["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("a_text"))
    return rows.mapInArrow(made, "doc_id long, groups string")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))
