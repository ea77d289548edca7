"""Jaccard join of word-shingle sets by filters under several global token orders.

Two sets with 100 * |intersection| >= percent * |union| share a token among the first ones of each, whatever total order
tokens are put in: n - ceil(percent * n / 100) + 1 of n tokens are enough. Candidates must share such a token under each of
``ORDERS`` orders, and not only one: what two prefixes share, and what the longer rest could add, must reach the overlap
that the sets' sizes ask for.

1. Tokens are 64-bit hashes of shingles. How many documents have each is counted by units of documents and buckets of
   tokens. All orders put rare tokens first (by the logarithm of that count) and differ in the hash that orders the rest.
   Counts are kept for the leading bits of tokens (``_bits``), which only makes some tokens look more frequent.
2. A token that one document has can't be shared; prefixes are sent without them. A set whose prefix is empty that way
   under some order has no partner and goes no further.
3. Sets that are equal are one class; classes go on. Classes that share a token of the first order's prefix form groups,
   and a pair of a group has to pass the prefixes of all orders before its full sets are compared (``stars``, which makes
   no pairs within a component). A pair that shares several tokens is looked at in the group of the smallest.
4. Components of the links that full sets confirm give each document its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stars
from . import units as U
from .common import deltas, materialize, mix, pack, read, slim, tune, unpack
from .neardup import set_hash, shingles

ORDERS = 3
LEAST, MOST = 4 << 20, 12 << 20  # bytes of text of a unit


def _bits(text_bytes: int) -> int:
    """Leading bits of tokens that are counted apart: some hundred times as many as there can be tokens."""
    return min(56, max(24, text_bytes.bit_length() + 4))


def _tokens(rows: pa.Table, width: int, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Each text's tokens; and the cells of all of them, where each token's cell is, and how many times cells occur."""
    sets = [shingles(t, width) for t in rows.column("s_text").to_pylist()]
    flat = np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - bits)
    return sets, *np.unique(flat, return_inverse=True, return_counts=True)


def _bounds(cells: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins in ordered cells."""
    return np.searchsorted(cells, np.array([(b << bits) // buckets for b in range(buckets + 1)], np.uint64))


def _sent(width: int, bits: int, buckets: int):
    def sent(unit: int, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, cells, _, times = _tokens(rows, width, bits)
        bounds = _bounds(cells, bits, buckets)
        for bucket in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[bucket], bounds[bucket + 1])
            yield bucket, pack(deltas(cells[own] - cells[own][:1]), slim(times[own]), cells[own][:1])

    return sent


def _levels(blobs: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Of each unit's cells, the bits of how many documents have them."""
    got = [unpack(b) for b in blobs]
    cells = [np.cumsum(c.astype(np.uint64), dtype=np.uint64) + first for c, _, first in got]
    known, place = np.unique(np.concatenate(cells), return_inverse=True)
    count = np.zeros(len(known), np.int64)
    np.add.at(count, place, np.concatenate([t.astype(np.int64) for _, t, _ in got]))
    level = np.frexp(count.astype(float))[1].astype(np.uint8)  # 1 for 1, 2 for 2 and 3, 3 from 4 on
    bounds = np.cumsum([0, *map(len, cells)])
    return [pack(level[place[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], [len(known)]


def prefixes(tokens: np.ndarray, level: np.ndarray, percent: int) -> list[np.ndarray]:
    """The tokens that others may have, of the first ones under each order."""
    first = len(tokens) + percent * len(tokens) // -100 + 1
    out = []
    for order in range(1, ORDERS + 1):
        key = level.astype(np.uint64) << np.uint64(56) | mix(tokens ^ np.uint64(order * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(8)
        at = np.argsort(key, kind="stable")[:first]  # equal keys: in order of tokens
        out.append(tokens[at[level[at] > 1]])
    return out


def _filter(n: int, tokens: list[np.ndarray]) -> bytes:
    """A set's size, its prefixes' lengths, its prefix under the first order, and those under the others by their tokens'
    leading 32 bits."""
    head = np.array([n, *map(len, tokens)], "<u4").tobytes()
    return b"".join([head, tokens[0].astype("<u8").tobytes(), *((t >> np.uint64(32)).astype("<u4").tobytes() for t in tokens[1:])])


def _parts(data: bytes) -> tuple[int, list[np.ndarray]]:
    n, first, *others = np.frombuffer(data, "<u4", 1 + ORDERS).tolist()
    at = 4 * (1 + ORDERS)
    out = [np.frombuffer(data, "<u8", first, at)]
    at += 8 * first
    for size in others:
        out.append(np.frombuffer(data, "<u4", size, at))
        at += 4 * size
    return n, out


def _sharing(percent: int):
    """Whether prefixes share as much under each order as sets of their sizes must. Of the tokens that two sets share,
    those up to the smaller of their prefixes' last tokens are in both prefixes, and the rest are beyond one of them."""

    def sharing(many: list[bytes], key: int | None):
        parts = [_parts(d) for d in many]
        sizes = np.array([n for n, _ in parts])
        own_key = None if key is None else np.int64(key).view(np.uint64)
        orders = []
        for k in range(ORDERS):
            length = np.array([len(p[k]) for _, p in parts])  # none is empty
            known, place = np.unique(np.concatenate([p[k] for _, p in parts]), return_inverse=True)
            orders.append((known, place, np.cumsum(length) - length))
        beyond = lambda n: -(-percent * n // 100) - 1  # noqa: E731  tokens after the prefix

        def shared(one: bytes) -> np.ndarray:
            n, prefixes_of = _parts(one)
            least = -(-percent * (sizes + n) // (100 + percent)) - np.maximum(beyond(sizes), beyond(n))
            fine = np.ones(len(many), bool)
            for k, (own, (known, place, begin)) in enumerate(zip(prefixes_of, orders, strict=True)):
                hit = np.isin(known, own)
                fine &= np.add.reduceat(hit[place], begin, dtype=np.int64) >= np.maximum(1, least)
                if k == 0 and own_key is not None:  # the smallest shared token has to be the group's
                    smallest = np.minimum.reduceat(np.where(hit[place], place, len(known)), begin)
                    fine &= smallest == np.searchsorted(known, own_key)
            return fine

        return shared

    return sharing


PREFIXED = "doc_id long, unit long, at int, n long, c long, keys array<long>, data binary"


def _prefixed(width: int, percent: int, bits: int, buckets: int):
    def prefixed(unit: int, rows: pa.Table, got: dict[tuple[int, int], bytes]) -> pa.Table:
        sets, cells, place, _ = _tokens(rows, width, bits)
        bounds, level = _bounds(cells, bits, buckets), np.ones(len(cells), np.uint8)
        for (_, bucket), blob in got.items():
            level[bounds[bucket] : bounds[bucket + 1]] = unpack(blob)[0]
        level, end, keys, data = level[place], 0, [], []
        for s in sets:
            end += len(s)
            found = prefixes(s, level[end - len(s) : end], percent)
            fine = all(map(len, found))
            keys.append(found[0].view(np.int64).tolist() if fine else [])
            data.append(_filter(len(s), found) if fine else None)
        columns = [rows.column("doc_id"), pa.array([unit] * len(sets), pa.int64()), pa.array(range(len(sets)), pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64())]
        return pa.table([*columns, pa.array(keys, pa.list_(pa.int64())), pa.array(data, pa.binary())], ["doc_id", "unit", "at", "n", "c", "keys", "data"])

    return prefixed


def _sets_at(width: int):
    def sets_at(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        texts = U.rows_of(left.column("blob")[0].as_py()).column("s_text").take(right.column("at")).to_pylist()
        sets = [shingles(t, width) for t in texts]
        return pa.table([right.column("c"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return sets_at


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. A null or empty text has no
    shingles and is linked with nothing. Rows that repeat a doc_id are linked by their own texts. A null doc_id never
    names a group that has another; alone, its component is null and it is kept."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("s_text"))
    text = U.text_of(rows, "s_text")
    made = U.units(rows, "s_text", U.side(text, LEAST, MOST))
    bits, buckets = _bits(text), U.buckets_for(text, U.side(text, LEAST, 4 * MOST))
    answers = materialize(U.meet(U.send(made, _sent(width, bits, buckets)), _levels, 1))
    every = materialize(U.back(made, answers.withColumn("kind", F.lit(0)), _prefixed(width, percent, bits, buckets), PREFIXED))

    full = every.where(F.col("n") > 0)
    first = F.min(F.struct("unit", "at")).alias("place")
    classes = materialize(full.groupBy("c").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("data").alias("data"), first))

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = classes.join(wanted, "c", "left_semi").select("c", "place.unit", "place.at")
        return materialize(made.select("unit", "blob").groupBy("unit").cogroup(places.groupBy("unit")).applyInArrow(_sets_at(width), "c long, n long, data binary"))

    keys = classes.select(F.explode("keys").alias("key"), "c")
    facts = classes.where(F.col("data").isNotNull()).select("c", "n", "data")
    return stars.named(every, classes, stars.roots(keys, facts, sets_of, _sharing(percent), percent))


def op13_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


SQL = {
    "op13_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
e AS MATERIALIZED (SELECT c, n, unnest(s) AS t FROM g WHERE n > 0),
common AS (SELECT a.c AS a, b.c AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM common WHERE 100 * k >= 90 * (an + bn - k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT c, c AS x FROM g UNION SELECT r.c, u.b FROM r JOIN u ON r.x = u.a),
m AS (SELECT c, min(x) AS component_id FROM r GROUP BY 1),
d AS (SELECT s.doc_id, g.n, g.c FROM (SELECT doc_id, list_sort(s) AS s FROM s) s JOIN g ON s.s = g.s)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM d JOIN m USING (c)"""
}
