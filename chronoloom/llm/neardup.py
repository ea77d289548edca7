"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes its set of word shingles. Texts with one set are one class; classes, not rows, go on.
2. Of each class: minima under ``HASHES`` hash functions, keys of bands of ``ROWS`` minima, and a signature of the
   minima's lowest ``BITS`` bits. A pair at the threshold misses all bands with a chance of about one in ten million.
3. Classes that share a band are candidates: first each with its band's leader, then those members of a band that aren't
   in its largest component with all its members (see ``stars``).
4. Candidates whose signatures agree too little (similarity corrected for chance agreement) are left out; the margin
   is five standard deviations. All others are confirmed on the full shingle sets.
5. Components of the confirmed links give each document its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stars
from .common import materialize, mix, read, release, tune

ROWS, BANDS, BITS = 5, 40, 4
HASHES = ROWS * BANDS
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32)).astype(np.uint32)
#: Pairs of bits that are equal in two signatures, by the bytes' exclusive or: 0, 1 or 2 of its halves are 0.
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased); with fewer words, of all of them."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.array(list(map(_words.__getitem__, words)), np.uint64)
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i])
    return np.unique(h)


def set_hash(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    if not len(hashes):
        return 0
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)))


def minima(hashes: np.ndarray) -> np.ndarray:
    x, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h.view(np.int64)


def signature(least: np.ndarray) -> bytes:
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from signatures (rows of bytes), corrected for minima that agree in their low bits by chance."""
    agree = _EQUAL[a ^ b].sum(axis=-1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def margin(similarity: float) -> float:
    chance = 2.0**-BITS
    agree = similarity + (1 - similarity) * chance
    return similarity - 5 * float(np.sqrt(agree * (1 - agree) / HASHES)) / (1 - chance)


def _sketch(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c, bands, sigs = [], [], [], []
            for text in batch.column("d_text").to_pylist():
                s = shingles(text, width)
                least = minima(s)
                n.append(len(s)), c.append(set_hash(s))
                bands.append(band_keys(least).astype("<i8").tobytes() if len(s) else b""), sigs.append(signature(least))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.binary())], ["doc_id", "n", "c", "sig", "bands"])

    return sketch


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, c: a row for each band of each class."""
    for batch in batches:
        bands = batch.column("bands").to_pylist()
        c = np.repeat(batch.column("c").to_numpy(), [len(b) // 8 for b in bands])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(bands), "<i8")), pa.array(c)], ["key", "c"])


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width) for t in batch.column("d_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["c", "n", "data"])

    return sets


def _likely(least: float):
    """Whether the signatures of two sets agree enough; in a band, only of pairs that share no band with a smaller key."""

    def split(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(b"".join(many), np.uint8).reshape(len(many), -1)
        return rows[:, : HASHES * BITS // 8], np.ascontiguousarray(rows[:, HASHES * BITS // 8 :]).view(np.int64)

    def likely(many: list[bytes], key: int | None):
        signatures, keys = split(many)

        def similar(one: bytes) -> np.ndarray:
            signature, own = (x[0] for x in split([one]))
            fine = estimate(signatures, signature) >= least
            if key is not None:
                fine &= np.where(keys == own, keys, np.iinfo(np.int64).max).min(axis=1) == key
            return fine

        return similar

    return likely


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. A null or empty text has
    no shingles and is linked with nothing. Rows that repeat a doc_id are linked by their own texts. A null doc_id
    never names a group that has another; alone, its component is null and it is kept.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("d_text"))
    every = materialize(rows.mapInArrow(_sketch(width), "doc_id long, n long, c long, sig binary, bands binary"))
    full = every.where(F.col("n") > 0)
    classes = materialize(full.groupBy("c").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    sketched, every = every, materialize(every.select("doc_id", "n", "c"))
    release(sketched)  # bands and signatures go on with the classes only

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = materialize(classes.join(wanted, "c", "left_semi").select(F.col("first").alias("w_id")).distinct())
        texts = rows.join(ids, rows.doc_id.eqNullSafe(ids.w_id), "left_semi").select("d_text")
        found = materialize(texts.mapInArrow(_sets(width), "c long, n long, data binary").dropDuplicates(["c"]))
        release(ids)
        return found

    keys = classes.select("c", "bands").mapInArrow(_keys, "key long, c long")
    facts = classes.select("c", "n", F.concat("sig", "bands").alias("data"))
    found = stars.roots(keys, facts, sets_of, _likely(margin(percent / 100)), percent)
    firsts = materialize(classes.select("c", "first"))
    release(classes)
    return stars.named(every, firsts, found)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)


SQL = {
    "op1_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
g AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
e AS MATERIALIZED (SELECT c, n, unnest(s) AS t FROM g WHERE n > 0),
common AS (SELECT a.c AS a, b.c AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (an + bn - k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT c, c AS x FROM g UNION SELECT r.c, u.b FROM r JOIN u ON r.x = u.a),
m AS (SELECT c, min(x) AS component_id FROM r GROUP BY 1),
d AS (SELECT s.doc_id, g.n, g.c FROM (SELECT doc_id, list_sort(s) AS s FROM s) s JOIN g ON s.s = g.s)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id, doc_id = CASE WHEN n = 0 THEN doc_id ELSE component_id END AS kept
FROM d JOIN m USING (c)"""
}
