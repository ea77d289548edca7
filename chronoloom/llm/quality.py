"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its bytes, its own and those of the lines beside it. The field labels each line bad or
good; forward-backward gives each line's marginal, and the marginals, weighted by line length, give the document's
quality. Training takes the labels of documents as labels of their lines, from a bounded sample. A last logistic
step, fitted on sample documents that the field did not see, sets scores so that ``CUT`` separates best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, kept_names, read, tune

#: Labelled documents that training sees at most, and the score from which a document counts as good.
SAMPLE, CUT = 3000, 0.3
CHUNK = 1 << 20

_CLASSES = np.zeros((9, 256), np.uint8)  # lower, upper, digit, space, stop, pipe, sign, markup, beyond ASCII
_CLASSES[0, 97:123] = _CLASSES[1, 65:91] = _CLASSES[2, 48:58] = _CLASSES[8, 128:] = 1
_CLASSES[3, [9, 11, 12, 13, 32]] = 1
_CLASSES[4, [33, 39, 44, 46, 58, 59, 63]] = 1
_CLASSES[5, 124] = 1
_CLASSES[7, [60, 62, 123, 125, 91, 93, 61, 47, 92]] = 1
_CLASSES[6, 33:127] = 1 - _CLASSES[[0, 1, 2, 4, 5, 7]][:, 33:127].max(axis=0)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: features (own, previous line's, next line's, 1), length in bytes, and lines per text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = (ends - starts).astype(np.float64)
    counts = np.array([t.count(b"\n") + 1 for t in texts])
    total = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64).astype(np.float64)  # noqa: E731  a line and its end
    kind = [total(row[data]) for row in _CLASSES]
    same = np.append(0, (data[1:] == data[:-1]) & (data[1:] != 10)).astype(np.uint8)
    twice = total(same)
    run = np.append([0, 0], same[2:] & same[1:-1]).astype(np.uint8) if len(data) > 2 else np.zeros(len(data), np.uint8)
    runs = total(run)
    space = _CLASSES[3][data] | (data == 10)
    words = total(np.append(1, space[:-1]) & (1 - space))
    sign_end = total(np.append(space[1:], 1) & (1 - space) & (_CLASSES[6] | _CLASSES[5] | _CLASSES[7])[data])
    bang = total((data == 33).astype(np.uint8))
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    # words equal to the one before in their line, by length and first 8 bytes
    first = np.flatnonzero(np.append(1, space[:-1]) & (1 - space))
    last = np.flatnonzero(np.append(space[1:], 1) & (1 - space))
    wide = np.ndarray((len(data),), "<u8", data.tobytes() + b"\0" * 8, 0, (1,))[first]
    long = np.minimum(last - first + 1, 8).astype(np.uint64)
    wide = wide << ((np.uint64(8) - long) * np.uint64(8)) if len(first) else wide
    line = np.searchsorted(starts, first, "right") - 1
    again = np.append(False, (wide[1:] == wide[:-1]) & ((last - first)[1:] == (last - first)[:-1]) & (line[1:] == line[:-1]))[: len(first)]
    repeat = np.bincount(line[again], minlength=len(starts))
    own = np.stack([
        repeat / w, np.minimum(repeat, 3) / 3, *(k / n for k in kind), twice / n, 5 * runs / n, np.minimum(size / w, 30) / 10, sign_end / w, bang / w, np.log1p(words) / 3, (size == 0) * 1.0,
        np.minimum(kind[1] / np.maximum(kind[0] + kind[1], 1), 1),
    ], axis=1)
    edge = np.cumsum(counts) - counts
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[edge] = 0
    after[edge + counts - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), size, counts


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by length, longest first: where each begins, and how many still run at each step."""
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    alive = np.searchsorted(-counts[order], -np.arange(counts.max()), "left") if len(counts) else np.empty(0, int)
    return order, begin, alive


def marginals(unary: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's log-marginals, and the log-partition of its chain; all chains go forward and back together."""
    _, begin, alive = _steps(counts)
    fwd, bwd = np.zeros_like(unary), np.zeros_like(unary)
    for t, n in enumerate(alive):
        at = begin[:n] + t
        fwd[at] = unary[at] if t == 0 else unary[at] + np.logaddexp(fwd[at - 1, :1] + pair[0], fwd[at - 1, 1:] + pair[1])
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        on = unary[at + 1] + bwd[at + 1]
        bwd[at] = np.stack([np.logaddexp(pair[s, 0] + on[:, 0], pair[s, 1] + on[:, 1]) for s in (0, 1)], axis=1)
    both = fwd + bwd
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    return both - log_z[:, None], log_z


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # features x 2
    pair: np.ndarray  # transitions
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of 'good' and length of every line, lines per text."""
        x, size, counts = features(texts)
        good, _ = marginals(((x - self.mean) / self.scale) @ self.weights, self.pair, counts)
        return np.exp(good[:, 1]), size, counts

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the marginals, as log-odds."""
        p, size, counts = self.lines(texts)
        at, weight = np.cumsum(counts) - counts, size + 1
        q = np.clip(np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at), 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.quality(texts) + self.shift)))


def train(texts: list[bytes], labels: list[int], steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    held = np.arange(len(texts)) % 3 == 2 if len(set(labels)) == 2 and len(texts) >= 30 else np.zeros(len(texts), bool)
    part = [t for t, h in zip(texts, held, strict=True) if not h]
    y = np.array(labels)[~held]
    x, size, counts = features(part)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    line_y = np.repeat(y, counts)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    weight = np.repeat(balance / counts, counts)  # a document counts once, whatever its length
    gold = np.eye(2)[line_y]
    edge = np.cumsum(counts) - counts
    inner = np.ones(len(x), bool)
    inner[edge] = False
    later = np.flatnonzero(inner)
    w, pair = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        unary = x @ w
        log_p, _ = marginals(unary, pair, counts)
        p = np.exp(log_p)
        grad_w = x.T @ ((p - gold) * weight[:, None]) / len(y) + ridge * w
        grad_pair = ridge * pair
        if len(later):
            # pair marginals from neighbouring marginals: p(a) * p(b | a)
            on = pair[None] + unary[later][:, None, :] + _backward(unary, pair, counts)[later][:, None, :]
            on = np.exp(on - np.logaddexp(on[:, :, :1], on[:, :, 1:]))
            joint = p[later - 1][:, :, None] * on
            seen = gold[later - 1][:, :, None] * gold[later][:, None, :]
            grad_pair = grad_pair + ((joint - seen) * weight[later][:, None, None]).sum(axis=0) / len(y)
        for k, (value, grad) in enumerate(((w, grad_w), (pair, grad_pair))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field = Field(mean, scale, w, pair)
    check = [t for t, h in zip(texts, held, strict=True) if h] or part
    check_y = np.array(labels)[held] if held.any() else y
    field.slope, field.shift = calibrated(field.quality(check), check_y)
    return field


def _backward(unary: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> np.ndarray:
    _, begin, alive = _steps(counts)
    bwd = np.zeros_like(unary)
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        on = unary[at + 1] + bwd[at + 1]
        bwd[at] = np.stack([np.logaddexp(pair[s, 0] + on[:, 0], pair[s, 1] + on[:, 1]) for s in (0, 1)], axis=1)
    return bwd


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic step that puts the cut of the best balanced accuracy at CUT."""
    if len(set(y.tolist())) < 2:
        return 1.0, 6.0 if len(y) == 0 or y[0] == 1 else -6.0
    order = np.argsort(z)
    z, y = z[order], y[order]
    bad_below = np.append(0, np.cumsum(y == 0)) / max((y == 0).sum(), 1)
    good_above = 1 - np.append(0, np.cumsum(y == 1)) / max((y == 1).sum(), 1)
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    worth = bad_below + good_above
    near = edges[worth >= worth.max() - 1e-12]
    cut = float((near.min() + near.max()) / 2)  # the middle of equally good cuts
    slope = float(np.clip(2.0 / max(z.std(), 1e-3), 0.2, 4.0))
    return slope, float(np.log(CUT / (1 - CUT)) - slope * cut)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Train on at most ``sample`` labelled documents (half of each label, if there are enough), the first by a hash of
    doc_id; None if no label meets a document. A doc_id with both labels counts as 0. Of rows that repeat a doc_id, at
    most 2 * ``sample`` take part, in order of that hash and their texts."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("q_id")).agg(F.min("quality").alias("q_label"))
    picked = [known.where(F.col("q_label") == y).orderBy(F.xxhash64("q_id"), "q_id").limit(sample // 2) for y in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most ``sample`` ids
    rows = docs.join(chosen, docs.doc_id == chosen.q_id).select("q_id", F.coalesce("text", F.lit("")).cast("binary").alias("q_text"), "q_label").orderBy(F.xxhash64("q_id"), "q_id", "q_text").limit(2 * sample)
    found = sorted(rows.collect(), key=lambda r: (r.q_id, bytes(r.q_text)))
    return train([bytes(r.q_text) for r in found], [r.q_label for r in found]) if found else None


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """All columns of docs but text, then score and predicted for every row; they replace columns of docs with those
    names.

    A null text is scored as an empty one: one line without bytes. Without a field (nothing to learn from) every
    score is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            scores, held, size = [], [], 0
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                held.append((text or "").encode())
                size += len(held[-1])
                if size >= CHUNK or i == len(texts) - 1:
                    scores.append(f.scores(held) if f is not None else np.ones(len(held)))
                    held, size = [], 0
            out = np.concatenate(scores) if scores else np.empty(0)
            kept = {n: batch.column(n) for n in batch.schema.names if n in names}
            yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(out), "predicted": pa.array((out >= CUT).astype("<i4"))})

    names = kept_names(docs, "score", "predicted")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)
    return docs.mapInArrow(scored, kept + "score double, predicted int")


def learned(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field as op5 learns it: from labels outside the held-out fold."""
    return fit(docs.select("doc_id", "text"), labels.where(crc_mod(F.col("doc_id"), 5) != 0))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), learned(docs, read(spark, sf_dir, "labels")))
