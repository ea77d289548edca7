"""Ranked lexical search by hashed max-sketches.

1. Units of documents hold each document's terms and how often it has them. Document frequencies of all terms are summed
   up by buckets of terms and go back to the units.
2. A unit folds the impacts of each document's terms (weight times saturated frequency) into a sketch: a term's hash
   names a coordinate, and a coordinate keeps the largest impact that falls on it, rounded up to 16 bits. A document's
   sketch is a power of two long, at least twice its distinct terms. Sketches of one length stand side by side.
3. Queries are looked up in batches: the coordinates of a batch's terms are gathered for all documents of a unit and
   summed up by query. No score is above that sum.
4. A first wave scores the ``LEAD`` highest bounds of each unit exactly; the k-th best of all units is a bar that holds
   everywhere. The second wave starts from it: a unit scores documents exactly in descending order of their bounds until
   the next bound is under the bar or under its own k-th score. What reaches the bar is merged by rank.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import units as U
from .common import deltas, materialize, mix, pack, read, slim, tune, unpack

LEAST, MOST = 4 << 20, 12 << 20  # bytes of text of a unit
MEMO = 500_000  # words remembered by a worker; the memo is emptied beyond that
BATCH = 1 << 22  # coordinates gathered at once
STEP = 64  # documents scored exactly between two looks at the next bound
LEAD = 2  # documents of a unit that a query's first bar may come from
TERMS = 200_000  # query terms that are searched for together
SALTS = 32  # parts of an item's candidates that are ranked by themselves first
#: Bytes that are no part of a term become blanks; A-Z become a-z.
FOLD = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class _Words(dict):
    """Numbers of a worker's words, and their hashes by number."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return found


_words = _Words()


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes by number, and the numbers of each text's terms."""
    global _words
    if len(_words) > MEMO:
        _words = _Words()
    found = []
    for text in texts:
        words = text.translate(FOLD).split() if text else ()
        found.append(np.fromiter(map(_words.__getitem__, words), np.int64, len(words)))
    return np.array(_words.hashes, np.uint64), found


def _counted(held: list[pa.RecordBatch]) -> bytes:
    """Documents, their lengths, the unit's terms in order of hashes, and each document's terms with frequencies."""
    hashes, found = terms([t for batch in held for t in batch.column("l_text").to_pylist()])
    n = np.array([len(f) for f in found], np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *found])
    own = np.flatnonzero(np.bincount(flat, minlength=len(hashes)))
    own = own[np.argsort(hashes[own])]
    place = np.zeros(len(hashes), np.int64)
    place[own] = np.arange(len(own))
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(own)) + place[flat], return_counts=True)
    doc, term = np.divmod(key, max(1, len(own)))
    ids = pa.chunked_array([batch.column("doc_id") for batch in held]).combine_chunks()
    none = np.array(ids.is_null().to_numpy(zero_copy_only=False), "u1")
    return pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), none, slim(n), hashes[own], slim(np.bincount(doc, minlength=len(n))), slim(term), slim(tf))


def _buckets(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return U.split((mix(hashes.copy()) % np.uint64(n)).astype(np.int64), n)


def _sent(buckets: int):
    def sent(unit: int, parts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        _, _, n, hashes, _, term, _ = parts
        df = np.bincount(term, minlength=len(hashes))
        order, bounds = _buckets(hashes, buckets)
        for bucket in range(buckets):
            at = order[bounds[bucket] : bounds[bucket + 1]]
            about = np.array([(n > 0).sum(), n.sum()] if bucket == 0 else [0, 0], "<i8")
            if len(at) or bucket == 0:
                yield bucket, pack(deltas(hashes[at]), slim(df[at]), about)

    return sent


def _added(blobs: list[bytes]) -> tuple[list[bytes], list[int]]:
    got = [unpack(b) for b in blobs]
    hashes = [np.cumsum(h.astype(np.uint64), dtype=np.uint64) for h, _, _ in got]
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    df = np.zeros(len(known), np.int64)
    np.add.at(df, place, np.concatenate([d.astype(np.int64) for _, d, _ in got]))
    bounds = np.cumsum([0, *map(len, hashes)])
    return [pack(slim(df[place[a:b]])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], [int(sum(a[i] for _, _, a in got)) for i in (0, 1)]


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    found, back = np.unique(df, return_inverse=True)
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in found.tolist()], np.int64)[back]


def saturated(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Term frequencies after saturation; whole numbers, rounded down at each division."""
    wide = int(n.max(initial=0)) * 90 * docs >= 2**63
    m = 10 + ((n.astype(object) if wide else n) * 90 * docs // max(1, length)).astype(np.int64)
    return 10**9 * tf // (1000 * tf + 8 * m)


def sketches(term_hash: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """log2 of each document's sketch length, all sketches (by length, coordinates by documents), and their unit's log2."""
    distinct = np.bincount(doc, minlength=docs)
    size = np.maximum(4, np.ceil(np.log2(np.maximum(1, 2 * distinct))).astype(np.int64))
    shift = max(0, int(impact.max(initial=0)).bit_length() - 16 + 1)
    value = (impact + (1 << shift) - 1 >> shift).astype(np.uint16)
    out = []
    for s in np.unique(size).tolist():
        members = np.flatnonzero(size == s)
        column = np.full(docs, -1)
        column[members] = np.arange(len(members))
        own = column[doc] >= 0
        flat = np.zeros(len(members) << s, np.uint16)
        coordinate = (term_hash[own] & np.uint64((1 << s) - 1)).astype(np.int64)
        np.maximum.at(flat, coordinate * len(members) + column[doc[own]], value[own])
        out.append(flat)
    return size.astype(np.uint8), np.concatenate([np.empty(0, np.uint16), *out]), shift


def _indexed(buckets: int, docs: int, length: int):
    def indexed(unit: int, parts: list[np.ndarray], got: dict[tuple[int, int], bytes]) -> pa.Table:
        ids, none, n, hashes, distinct, term, tf = parts
        df = np.ones(len(hashes), np.int64)
        order, bounds = _buckets(hashes, buckets)
        for (_, bucket), blob in got.items():
            df[order[bounds[bucket] : bounds[bucket + 1]]] = unpack(blob)[0]
        w, doc = weights(df, docs), np.repeat(np.arange(len(ids)), distinct)
        impact = w[term] * saturated(tf.astype(np.int64), n.astype(np.int64)[doc], docs, length)
        size, flat, shift = sketches(hashes[term], doc, impact, len(ids))
        blob = pack(ids, none, n, hashes, distinct, term, tf, slim(w), size, flat, np.array([shift, docs, length], "<i8"))
        return pa.table({"unit": pa.array([unit], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return indexed


def index(docs: DataFrame) -> DataFrame:
    """unit, blob: documents with their terms and sketches, for ``search``; a written table."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("l_text"))
    text = U.text_of(rows, "l_text")
    made = U.units(rows, "l_text", U.side(text, LEAST, MOST), _counted)
    buckets = U.buckets_for(text, U.side(text, LEAST, 16 * MOST))
    answers = materialize(U.meet(U.send(made, _sent(buckets), unpack), _added, 2))
    docs_with_terms, length = U.total(answers, 2)
    return materialize(U.back(made, answers.withColumn("kind", F.lit(0)), _indexed(buckets, docs_with_terms, length), "unit long, blob binary", unpack))


class Unit:
    """A unit's documents for bounds and exact scores."""

    def __init__(self, blob: bytes):
        self.ids, self.none, n, self.hashes, distinct, term, self.tf, self.w, size, flat, (self.shift, self.docs, self.length) = unpack(blob)
        self.n = n.astype(np.int64)
        self.width = max(1, len(self.hashes))
        self.key = np.repeat(np.arange(len(self.ids)), distinct) * self.width + term
        self.groups, at = [], 0
        for s in np.unique(size).tolist():
            members = np.flatnonzero(size == s)
            end = at + (len(members) << s)
            self.groups.append((s, members, flat[at:end].reshape(1 << s, len(members))))
            at = end

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes among the unit's own terms; others go."""
        at = np.searchsorted(self.hashes, hashes)
        inside = at < len(self.hashes)
        at, hashes = at[inside], hashes[inside]
        return at[self.hashes[at] == hashes]

    def bounds(self, queries: list[np.ndarray]) -> np.ndarray:
        """A row for each query (places of terms), a column for each document."""
        out = np.zeros((len(queries), len(self.ids)), np.int64)
        some = [i for i, q in enumerate(queries) if len(q)]
        starts = np.cumsum([0, *(len(queries[i]) for i in some)])
        flat = self.hashes[np.concatenate([queries[i] for i in some])] if some else self.hashes[:0]
        for s, members, sketch in self.groups:
            coordinate = (flat & np.uint64((1 << s) - 1)).astype(np.int64)
            first = 0
            while first < len(some):
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + BATCH // len(members), "right")) - 1)
                got = sketch[coordinate[starts[first] : starts[last]]]
                sums = np.add.reduceat(got, starts[first:last] - starts[first], axis=0, dtype=np.int64)
                out[np.array(some[first:last])[:, None], members] = sums << self.shift
                first = last
        return out

    def scores(self, query: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents."""
        key = docs[:, None] * self.width + query
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        part = saturated(np.where(hit, self.tf[at], 0).astype(np.int64), np.broadcast_to(self.n[docs][:, None], key.shape), int(self.docs), int(self.length))
        return (part * self.w.astype(np.int64)[query]).sum(axis=1)

    def rank(self, docs: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Order by score, then doc_id, nulls last."""
        return np.lexsort((self.ids[docs], self.none[docs], -score))

    def best(self, query: np.ndarray, bound: np.ndarray, bar: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents that reach the bar, by exact scores in descending order of bounds."""
        at = np.flatnonzero(bound >= max(1, bar))
        at = at[np.argsort(-bound[at], kind="stable")]
        docs, score = at[:0], bound[:0]
        for start in range(0, len(at), STEP):
            own = score[-1] if len(docs) == k else 0
            if bound[at[start]] < max(bar, own):
                break
            more = at[start : start + STEP]
            found = self.scores(query, more)
            fine = found >= max(1, bar)
            docs, score = np.append(docs, more[fine]), np.append(score, found[fine])
            top = self.rank(docs, score)[:k]
            docs, score = docs[top], score[top]
        return docs, score


FOUND = "query int, unit long, doc_id long, score long"


def _searched(queries: list[np.ndarray], bars: dict[int, int] | None, k: int):
    """The first wave (no bars yet) or the second one."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("unit").to_pylist(), batch.column("blob"), strict=True):
                unit = Unit(blob.as_py())
                asked = [unit.known(q) for q in queries]
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                step = max(1, BATCH // max(1, len(unit.ids)))
                for first in range(0, len(asked), step):
                    for i, bound in enumerate(unit.bounds(asked[first : first + step]), first):
                        if bars is None:
                            docs = np.argpartition(-bound, LEAD)[:LEAD] if len(bound) > LEAD else np.arange(len(bound))
                            docs = docs[bound[docs] > 0]
                            out.append((i, docs, unit.scores(asked[i], docs) if len(docs) else bound[:0]))
                        else:
                            out.append((i, *unit.best(asked[i], bound, bars.get(i, 0), k)))
                size = [len(d) for _, d, _ in out]
                docs, score = (np.concatenate([np.empty(0, np.int64), *(o[c] for o in out)]).astype(np.int64) for c in (1, 2))
                columns = [pa.array(np.repeat([i for i, *_ in out], size).astype(np.int32), pa.int32()), pa.array([name] * len(docs), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(unit.ids[docs], pa.int64(), mask=unit.none[docs].astype(bool)), pa.array(score)], ["query", "unit", "doc_id", "score"])

    return searched


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank: within parts of its units first, so that no task sorts all rows."""
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    part = F.row_number().over(Window.partitionBy("query", F.pmod(F.hash("unit"), F.lit(SALTS))).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("int")
    return found.withColumn("rank", part).where(F.col("rank") <= k).withColumn("rank", rank).where(F.col("rank") <= k)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, found = terms(batch.column("q_text").to_pylist())
        sets = [hashes[np.unique(f)].view(np.int64).tolist() for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "terms"])


def search(made: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: of each item, the k documents of an index with the highest scores above 0.

    Rows that repeat an item_id (or have a null one) are one item with all their terms. An item without terms, or whose
    terms no document has, has no rows. Rows that repeat a doc_id are documents of their own; null ids rank last among
    equal scores. Items are searched for in blocks of about ``TERMS`` terms."""
    spark = made.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("q_text"))
    own = own.mapInArrow(_query_terms, "item_id long, terms array<long>").select("item_id", F.explode("terms").alias("term")).distinct()
    own = materialize(own.groupBy("item_id").agg(F.collect_list("term").alias("terms")))
    blocks = max(1, math.ceil((own.agg(F.sum(F.size("terms"))).first()[0] or 0) / TERMS))
    out = None
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about TERMS terms
        if not rows and (block or blocks > 1):
            continue
        queries = [np.sort(np.array(r.terms, np.int64).view(np.uint64)) for r in rows]
        first = _ranked(made.mapInArrow(_searched(queries, None, k), FOUND), k).where(F.col("rank") == k)
        bars = {r.query: r.score for r in first.select("query", "score").collect()}
        best = _ranked(made.mapInArrow(_searched(queries, bars, k), FOUND), k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "query int, item_id long")
        best = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = {
    "op11_search": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
a AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
f AS MATERIALIZED (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * a.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY t, a.n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
m AS (SELECT r, doc_id, 10 + (90 * len(t) * a.n) // a.l AS m FROM d, a WHERE len(t) > 0),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
}
