"""Gradient-boosted trees of bounded depth on binned inputs, grown in one task or over shards of rows.

Trees need rows only for sums by node, feature and bin. A group of few rows is summed up in one task; the rows of a large
one stay in shards all over the cluster, each level of a tree is one job that adds up the shards' sums, and a group's
splits are chosen where its sums come together. Both ways see every row and give the same trees, up to rounding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

BITS, LEAF = 6, 20  # rows of a leaf at least
BINS = 1 << BITS  # quantiles that may be split at
FRACTIONS = np.linspace(0, 1, BINS + 1)[1:-1]
SHARD, BLOCK = 1_000_000, 1 << 17  # rows of a large group that lie together, and rows that are summed up at once
CUT = 50  # trees after which shards are written, so that what they are made from doesn't grow long

Split = tuple[np.ndarray, np.ndarray, np.ndarray]  # of a level's nodes: feature, last bin that goes left; what their halves add as leaves


@dataclass
class Trees:
    """Boosted trees of one depth: a tree is a row of splits by level order, and a value for each leaf."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # a row goes right if it is larger
    leaf: np.ndarray  # trees x leaves
    start: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - inner]
        return out


@dataclass
class Rows:
    """Binned rows of a group: codes has two features in a number, score is what the trees so far say."""

    codes: np.ndarray
    width: int
    y: np.ndarray
    score: np.ndarray

    def blocks(self) -> Iterator[slice]:
        return (slice(i, i + BLOCK) for i in range(0, len(self.y), BLOCK))

    def lowered(self, node: np.ndarray, split: Split) -> None:
        """Moves rows from their nodes of a level to those of the next."""
        feature, limit, _ = split
        pair, shift, limit = feature // 2, (BITS * (1 - feature % 2)).astype(np.uint16), limit.astype(np.uint16)
        for at in self.blocks():
            n, codes = node[at], self.codes[at]
            code = codes.ravel().take(np.arange(len(n)) * codes.shape[1] + pair.take(n))
            node[at] = 2 * n + ((code >> shift.take(n)) & np.uint16(BINS - 1) > limit.take(n))

    def nodes(self, tree: list[Split]) -> np.ndarray:
        node = np.zeros(len(self.y), np.int32)
        for split in tree:
            self.lowered(node, split)
        return node

    def grown(self, tree: list[Split]) -> Rows:
        return Rows(self.codes, self.width, self.y, self.score + tree[-1][2][self.nodes(tree)]) if tree else self


def binned(x: np.ndarray, limits: np.ndarray, y: np.ndarray, start: float) -> Rows:
    width = x.shape[1]
    bins = np.zeros((len(x), width + width % 2), np.uint16)
    for f in range(width):
        bins[:, f] = np.searchsorted(limits[f], x[:, f], "left")
    return Rows((bins[:, ::2] << BITS) | bins[:, 1::2], width, y, np.full(len(y), start))


@dataclass(frozen=True)
class Boosting:
    """Least squares or logistic loss, second order."""

    trees: int
    depth: int
    rate: float
    logistic: bool = False

    def start(self, mean: float) -> float:
        share = float(np.clip(mean, 1e-6, 1 - 1e-6))
        return float(np.log(share / (1 - share))) if self.logistic else mean

    def sums(self, rows: Rows, node: np.ndarray, level: int) -> np.ndarray:
        """Slopes, counts and, with logistic loss, bends of a level's rows: each by node, feature and bin."""
        n, pairs = 2**level, rows.codes.shape[1]
        size = n * BINS * BINS
        out = np.zeros((3 if self.logistic else 2, pairs, size))
        for at in rows.blocks():
            y, score = rows.y[at], rows.score[at]
            p = 1 / (1 + np.exp(-score)) if self.logistic else score
            slope, bend = y - p, np.maximum(p * (1 - p), 1e-9) if self.logistic else None
            cell = node[at].astype(np.int64) << 2 * BITS
            for i in range(pairs):
                flat = cell + rows.codes[at, i]
                out[0, i] += np.bincount(flat, slope, size)
                out[1, i] += np.bincount(flat, minlength=size)
                if bend is not None:
                    out[2, i] += np.bincount(flat, bend, size)
        both = out.reshape(-1, pairs, n, BINS, BINS)
        single = np.stack([both.sum(axis=4), both.sum(axis=3)], axis=2)  # what x pairs x 2 x nodes x bins
        return np.moveaxis(single.reshape(len(out), 2 * pairs, n, BINS)[:, : rows.width], 1, 2)

    def split(self, sums: np.ndarray) -> Split:
        """The best split of each node, and what the leaves under it would add."""
        g, c = sums[0], sums[1]
        h = sums[2] if self.logistic else c  # squares all bend by 1
        n = np.arange(len(g))
        left_g, left_h, left = (a.cumsum(axis=2)[:, :, :-1] for a in (g, h, c))
        all_g, all_h, every = (a.sum(axis=2, keepdims=True) for a in (g, h, c))
        gain = left_g**2 / (left_h + 1e-3) + (all_g - left_g) ** 2 / (all_h - left_h + 1e-3) - all_g**2 / (all_h + 1e-3)
        gain[(left < LEAF) | (every - left < LEAF)] = 0
        best = gain.reshape(len(g), -1).argmax(axis=1)
        f, b = best // (BINS - 1), best % (BINS - 1)
        fine = gain[n, f, b] > 1e-12
        halves = lambda part, whole: np.stack([np.where(fine, part[n, f, b], whole[n, f, 0]), np.where(fine, whole[n, f, 0] - part[n, f, b], 0)], axis=1)
        return f, np.where(fine, b, BINS), (self.rate * halves(left_g, all_g) / (halves(left_h, all_h) + 1e-3)).ravel()

    def model(self, made: list[list[Split]], limits: np.ndarray, start: float) -> Trees:
        inner = 2**self.depth - 1
        model = Trees(np.zeros((len(made), inner), np.int64), np.full((len(made), inner), np.inf), np.zeros((len(made), inner + 1)), start)
        ends = np.hstack([limits, np.full((len(limits), 2), np.inf)])  # BINS: none goes right
        for k, tree in enumerate(made):
            for level, (f, b, leaf) in enumerate(tree):
                at = slice(2**level - 1, 2 ** (level + 1) - 1)
                model.feature[k, at], model.limit[k, at], model.leaf[k, : len(leaf)] = f, ends[f, b], leaf
        return model


def boosted(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, logistic: bool = False) -> Trees:
    """Trees of rows in memory; splits at BINS quantiles of each feature, a level at a time."""
    how = Boosting(trees, depth, rate, logistic)
    limits = np.stack([np.quantile(c, FRACTIONS) for c in x.T]) if len(x) else np.zeros((x.shape[1], BINS - 1))
    start = how.start(float(y.mean())) if len(y) else 0.0
    rows, made = binned(x, limits, y, start), []
    for _ in range(trees):
        node, tree = np.zeros(len(y), np.int32), []
        for level in range(depth):
            tree.append(how.split(how.sums(rows, node, level)))
            rows.lowered(node, tree[-1])
        if tree:
            rows.score += tree[-1][2][node]
        made.append(tree)
    return how.model(made, limits, start)


TOP = np.uint64(1 << 63)


def _keys(x: np.ndarray) -> np.ndarray:
    """Integers in the order of doubles."""
    u = (x + 0.0).view(np.uint64)  # one zero only
    return np.where(u >= TOP, ~u, u | TOP)


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >= TOP, keys ^ TOP, ~keys).view(float)


def quantiles(shards: RDD, counts: list[int], width: int) -> list[np.ndarray]:
    """np.quantile of all rows of each group, from (group, rows x features) shards: its order statistics are found a byte
    of their keys at a time, by counts of smaller keys."""
    ordered = shards.mapValues(lambda x: np.sort(_keys(x), axis=0)).persist(StorageLevel.MEMORY_AND_DISK)
    places = [FRACTIONS * (n - 1) for n in counts]
    ranks = [np.concatenate([np.floor(p), np.minimum(np.floor(p) + 1, n - 1)]).astype(np.int64) for p, n in zip(places, counts, strict=True)]
    found = [np.zeros((width, len(r)), np.uint64) for r in ranks]

    def below(part: Iterable, found: list[np.ndarray], shift: int) -> Iterator:
        steps = (np.arange(1, 256, dtype=np.uint64) << np.uint64(shift)) - np.uint64(1)
        for i, keys in part:
            ends = found[i][:, :, None] + steps
            yield i, np.stack([np.searchsorted(k, e.ravel(), "right").reshape(e.shape) for k, e in zip(keys.T, ends, strict=True)])

    for shift in range(56, -1, -8):
        sums = ordered.mapPartitions(partial(below, found=found, shift=shift)).reduceByKey(np.add, _parts(ordered, counts))
        for i, byte in sums.map(lambda s: (s[0], (s[1] <= ranks[s[0]][:, None]).sum(axis=2))).collect():
            found[i] = found[i] + (byte.astype(np.uint64) << np.uint64(shift))
    ordered.unpersist()
    limits = []
    for p, keys in zip(places, found, strict=True):
        low, high = np.split(_doubles(keys), 2, axis=1)
        t = p - np.floor(p)
        limits.append(np.where(t < 0.5, low + (high - low) * t, high - (high - low) * (1 - t)))
    return limits


def _parts(shards: RDD, groups: list) -> int:
    return max(1, min(len(groups), shards.getNumPartitions()))


def _stored(rows: RDD, frame: DataFrame) -> RDD:
    """The same shards, read from a table."""
    table = frame.sparkSession.createDataFrame(rows.map(lambda r: (r[0], cloudpickle.dumps(r[1]))), "i int, bytes binary")
    return written(table).rdd.map(lambda r: (r.i, cloudpickle.loads(r.bytes)))


def boosted_shards(rows: DataFrame, group: str, order: str, inputs: tuple[str, ...], y: str, how: Boosting, scaled: bool) -> list[tuple[str, np.ndarray, np.ndarray, float, Trees]]:
    """Trees of each group of a few large ones, with the mean and spread that its inputs were standardised by and the scale
    of y (1, unless scaled). A group's trees pass through the driver, its rows don't."""
    columns = [*inputs, y]
    numbers = rows.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias("m_" + c) for c in columns), *(F.stddev_pop(c).alias("s_" + c) for c in columns))
    stats = numbers.collect()
    width, at = len(inputs), {r[group]: i for i, r in enumerate(stats)}
    mean, spread = (np.array([[r[k + c] for c in inputs] for r in stats]) for k in ("m_", "s_"))
    spread[spread == 0] = 1.0
    scale = [(r["s_" + y] or 1.0) if scaled else 1.0 for r in stats]
    start = [how.start(r["m_" + y] / s) for r, s in zip(stats, scale, strict=True)]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, []
        shard = lambda: pd.DataFrame({"name": [name], "rows": [np.concatenate(held).tobytes()]})
        for pdf in batches:
            for c, part in pdf.groupby(group, sort=False):
                if held and (c != name or sum(map(len, held)) >= 2 * SHARD):
                    yield shard()
                    held = []
                name = c
                held.append(part[columns].to_numpy(float))
        if held:
            yield shard()

    total = sum(r.n for r in stats)
    dealt = rows.select(group, order, *columns).repartitionByRange(-(-total // SHARD), group, order).sortWithinPartitions(group, order)

    def unpacked(r) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
        i, found = at[r.name], np.frombuffer(r.rows).reshape(-1, width + 1)
        return i, ((found[:, :-1] - mean[i]) / spread[i], found[:, -1] / scale[i])

    whole = dealt.mapInPandas(packed, "name string, rows binary").rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    limits = quantiles(whole.mapValues(lambda v: v[0]), [r.n for r in stats], width)
    shards = whole.map(lambda r: (r[0], binned(r[1][0], limits[r[0]], r[1][1], start[r[0]]))).persist(StorageLevel.MEMORY_AND_DISK)

    def level_sums(part: Iterable, grown: list[list[Split]]) -> Iterator:
        found: dict[int, np.ndarray] = {}
        for i, r in part:
            sums = how.sums(r, r.nodes(grown[i]), len(grown[i]))
            found[i] = found[i] + sums if i in found else sums
        return iter(found.items())

    made: list[list[list[Split]]] = [[] for _ in stats]
    used = whole
    for k in range(how.trees):
        grown: list[list[Split]] = [[] for _ in stats]
        for _ in range(how.depth):
            sums = shards.mapPartitions(partial(level_sums, grown=grown)).reduceByKey(np.add, _parts(shards, stats))
            for i, split in sums.mapValues(how.split).collect():
                grown[i].append(split)
            if used is not None:  # the first level has made the shards
                used.unpersist()
                used = None
        for trees, tree in zip(made, grown, strict=True):
            trees.append(tree)
        if k + 1 < how.trees:
            used, shards = shards, shards.map(lambda r, grown=grown: (r[0], r[1].grown(grown[r[0]])))
            shards = (_stored(shards, rows) if (k + 1) % CUT == 0 else shards).persist(StorageLevel.MEMORY_AND_DISK)
    for rdd in (shards, used):
        if rdd is not None:
            rdd.unpersist()
    return [(r[group], mean[i], spread[i], scale[i], how.model(made[i], limits[i], start[i])) for i, r in enumerate(stats)]
