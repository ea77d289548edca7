"""Exact top-k inner product search by MaxScore over shards.

Dimensions are the query's terms. In a shard, a term adds at least ``low`` and at most ``high`` to a score, known
from the shard's extremes. Terms are split by the room between the two: those whose rooms together can't lift the
sum of lows to the current k-th score are non-essential. A row without a gain in any essential term can't enter.
Essential terms are summed for a block of rows; the others are probed term group by term group, only for rows
that are still competitive. Shards are merged by rank.

A first wave scores each block of queries against one shard only. The k-th scores found there go with the block as bars
to all shards, so that none starts without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pack, read, tune, unpack

SHARD, QUERIES = 4096, 1024  # rows of a shard, queries of a block
PRIME, BLOCK, PROBE, TOGETHER = 512, 2048, 8, 64  # rows scored fully at first, rows of a block, terms of a probe, queries walked together


def quantized(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component. Rows with a null id, a null vector, or a null or non-finite
    component take no part."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def exact_type(rows: np.ndarray, q: np.ndarray) -> type:
    """A type in which no sum of products of rows and queries is rounded: doubles up to 2**53, longs, else Python's."""
    most = lambda m: np.abs(m.astype(float)).max(axis=0, initial=0)
    bound = float(most(rows) @ most(q)) * 1.001
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


NO_BAR = -(2**63)


def maxscore(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query, the k best rows of a shard: scores and ids, ties to smaller ids, its own row left out. Rows below a
    query's bar may be missing.

    Queries are walked together, each with its own bar, order of terms and essential terms. Scores are exact."""
    width = min(rows.shape[1], queries.shape[1])  # a missing component counts as 0
    kind = exact_type(rows[:, :width], queries[:, :width])
    rows, q = rows[:, :width].astype(kind), queries[:, :width].astype(kind)
    least, most = rows.min(axis=0, initial=0), rows.max(axis=0, initial=0)
    high, low = np.maximum(q * most, q * least), np.minimum(q * most, q * least)
    order = np.argsort(low - high, axis=1, kind="stable")  # the terms with most room first
    each = np.arange(len(q))[:, None]
    after = np.zeros((len(q), width + 1), kind)
    after[:, :-1] = np.cumsum((high - low)[each, order][:, ::-1], axis=1)[:, ::-1]
    lift = low.sum(axis=1, keepdims=True) + after  # lift[:, i]: the most a score can be without a gain in the terms before i
    place = np.argsort(order, axis=1, kind="stable")
    best = [(np.empty(0, kind), np.empty(0, np.int64)) for _ in q]
    # the k-th score of a query, once it has k
    bar, full = (np.zeros(len(q), kind), np.zeros(len(q), bool)) if bars is None else (np.where(bars > NO_BAR, bars, 0).astype(kind), bars > NO_BAR)
    start, size = 0, PRIME
    while start < len(ids):
        block, names = rows[start : start + size], ids[start : start + size]
        essential = np.where(full, (lift >= bar[:, None]).sum(axis=1), width)
        mask = place < essential[:, None]
        score = (q * mask) @ block.T  # traversal of the essential postings
        alive = names[None, :] != query_ids[:, None]
        while True:
            rest = np.where(mask, 0, high).sum(axis=1)
            alive &= (score + rest[:, None] >= bar[:, None]) | ~full[:, None]
            if mask.all():
                break
            at = np.flatnonzero(alive.any(axis=0))  # rows that are competitive for a query; the next terms are probed for them
            essential = essential + PROBE
            probe = ~mask & (place < essential[:, None])
            block, names, score, alive = block[at], names[at], score[:, at] + (q * probe) @ block[at].T, alive[:, at]
            mask |= probe
        who, at = np.nonzero(alive)
        score = score[who, at]
        if kind is object:  # beyond 64 bits: the nearest long, which is what rows are ranked by
            score = np.minimum(np.maximum(score, -(2**63)), 2**63 - 1)
        bounds = np.searchsorted(who, np.arange(len(q) + 1))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            found = slice(bounds[i], bounds[i + 1])
            s, n = np.append(best[i][0], score[found]), np.append(best[i][1], names[at[found]])
            top = np.argsort(n, kind="stable")
            top = top[np.argsort(-s[top], kind="stable")][:k]
            best[i] = s[top], n[top]
            if len(top) == k:
                bar[i], full[i] = max(s[top[-1]], bar[i]) if full[i] else s[top[-1]], True
        start, size = start + size, BLOCK
    return best


def _packed(key: str):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        lens = pdf.v.map(len).to_numpy("<i4")
        flat = np.concatenate([np.asarray(x, "<i8") for x in pdf.v]) if len(pdf) else np.empty(0, "<i8")
        bars = [np.full(len(pdf), NO_BAR, "<i8")] if key == "block" else []
        return pd.DataFrame({key: [pdf[key].iloc[0]], "blob_" + key: [pack(pdf.vec_id.to_numpy("<i8"), lens, flat, *bars)]})

    return packed


def _matrix(packed: bytes | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, lens, flat = unpack(packed) if isinstance(packed, bytes) else packed
    width = int(lens.max()) if len(lens) else 0
    out = np.zeros((len(ids), width), np.int64)
    out[np.arange(width) < lens[:, None]] = flat
    return ids, lens, out


def _found(pdf: pd.DataFrame, k: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(block, query ids, best of each query) of each pair of shard and block."""
    for shard, block in zip(pdf.blob_shard, pdf.blob_block, strict=True):
        ids, _, rows = _matrix(shard)
        *vectors, bars = unpack(block)
        query_ids, _, queries = _matrix(vectors)
        steps = range(0, len(queries), TOGETHER)
        yield block, query_ids, [x for a in steps for x in maxscore(ids, rows, query_ids[a : a + TOGETHER], queries[a : a + TOGETHER], k, bars[a : a + TOGETHER])]


def _barred(k: int):
    """Blocks with the k-th scores that one shard gave as bars."""

    def barred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for block, _, found in _found(pdf, k):
                *vectors, _ = unpack(block)
                out.append(pack(*vectors, np.array([int(s[-1]) if len(s) == k else NO_BAR for s, _ in found], "<i8")))
            yield pd.DataFrame({"block": pdf.block, "blob_block": out})

    return barred


def _scored(k: int):
    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, query_ids, found in _found(pdf, k):
                yield pd.DataFrame({
                    "query_id": np.repeat(query_ids, [len(s) for s, _ in found]),
                    "vec_id": np.concatenate([i for _, i in found]) if found else np.empty(0, np.int64),
                    "score": np.concatenate([s for s, _ in found]).astype(np.int64) if found else np.empty(0, np.int64),
                })

    return scored


def search(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query (vec_id divisible by ``every``).

    Every row with another vec_id is a candidate, repeated rows each for itself; a repeated query row is one query, and
    different vectors of one query_id share its k ranks. Missing components count as 0. Scores are exact sums of whole
    components (those beyond 64 bits are cut to 64 bits); a score beyond 64 bits counts as the nearest long."""
    spark = embeddings.sparkSession
    tune(spark)
    vectors = materialize(quantized(embeddings, scale))
    n, nq = vectors.agg(F.count("*"), F.coalesce(F.count_if(F.col("vec_id") % every == 0), F.lit(0))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-nq // QUERIES))
    part = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    ask = vectors.where(F.col("vec_id") % every == 0).distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    part = part.groupBy("shard").applyInPandas(_packed("shard"), "shard long, blob_shard binary")
    ask = ask.groupBy("block").applyInPandas(_packed("block"), "block long, blob_block binary")
    part, ask = materialize(part), materialize(ask)
    one = ask.withColumn("shard", F.pmod("block", F.lit(shards))).join(part, "shard")
    ask = one.repartition(blocks, "block").select("block", "blob_shard", "blob_block").mapInPandas(_barred(k), "block long, blob_block binary")
    tasks = part.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(ask, "block")
    spread = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = tasks.repartition(spread).select("blob_shard", "blob_block").mapInPandas(_scored(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


SQL = {
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
