"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's features are its byte 2-, 3- and 4-grams, hashed into ``BUCKETS`` rows of an embedding table. The mean of
their embeddings goes through a linear layer and a softmax. Both layers are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows. For prediction the two layers are multiplied out, so a gram costs one
row of as many numbers as there are languages. A temperature fitted on held-back sample rows calibrates the scores;
texts whose score falls below the value that only a small share of right answers misses are marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, kept_names, read, tune

BUCKETS, WIDTH = 1 << 15, 16
#: Labelled rows that training sees at most; of those, whole texts.
SAMPLE = 2000
RESULTS = ("lang_pred", "score", "rejected")
CHUNK = 1 << 20
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def prepared(text: str) -> bytes:
    """Lower-case UTF-8; every other ASCII sign becomes a space."""
    return text.lower().encode().translate(_LETTERS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all 2-, 3- and 4-grams (three rows, a column for each position), each text's first column and the
    number of its grams in a row. Columns between texts hold BUCKETS, which is no bucket."""
    sizes = np.array([len(t) + 5 for t in texts])
    data = np.frombuffer(b"".join(b" " + t + b"    " for t in texts) + b"   ", np.uint8).astype(np.uint32)
    n = len(data) - 3
    first = np.cumsum(sizes) - sizes
    out = np.empty((3, n), np.int32)
    h = data[:n].copy()
    for k in (1, 2, 3):
        h *= np.uint32(0x01000193)
        h += data[k : n + k]
        out[k - 1] = ((h + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(17)
    for back in (1, 2, 3):
        out[:, first + sizes - back] = BUCKETS
    return out, first, sizes - 3


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        found, first, count = grams(texts)
        table = np.vstack([self.table, np.zeros((1, len(self.langs)), np.float32)])
        total = sum(np.add.reduceat(table.take(row, axis=0), first, axis=0) for row in found)
        return total / (3 * count[:, None]) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 6, batch: int = 32, rate: float = 0.5, accept: float = 0.995, seed: int = 5) -> Model:
    """Every text also gives a few short cuts, so that scores of short texts are learned and calibrated too."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    index = {n: i for i, n in enumerate(names)}
    rows: list[tuple[np.ndarray, np.ndarray, int, bool]] = []  # different grams, their shares, language, held back
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        words = text.split()
        cuts = [text] + [" ".join(words[a : a + int(rng.integers(1, 12))]) for a in (rng.integers(0, len(words), 3) if words else ())]
        for cut in cuts:
            if has_letter(cut):
                found = grams([prepared(cut)])[0]
                which, times = np.unique(found[found < BUCKETS], return_counts=True)
                rows.append((which, (times / times.sum()).astype(np.float32), index[lang], i % 5 == 4))
    held = [r for r in rows if r[3]] or rows
    rows = [r for r in rows if not r[3]] or rows
    share = np.bincount([y for _, _, y, _ in rows], minlength=len(names)) / max(len(rows), 1)
    weight = 1 / np.maximum(share * len(names), 1e-3)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    lin, bias = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[i] for i in order[at : at + batch]]
            flat, part_of = np.concatenate([g for g, *_ in part]), np.repeat(np.arange(len(part)), [len(g) for g, *_ in part])
            y = np.array([c for _, _, c, _ in part])
            # rows x grams: the share of each gram in each row
            key, back = np.unique(flat, return_inverse=True)
            shares = np.zeros((len(part), len(key)), np.float32)
            shares[part_of, back] = np.concatenate([w for _, w, *_ in part])
            mean = shares @ emb[key]
            z = mean @ lin + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(part))[:, None]
            step = rate * (1 - epoch / epochs)
            down = (p @ lin.T).astype(np.float32)
            lin -= step * (mean.T @ p).astype(np.float32)
            bias -= step * p.sum(axis=0).astype(np.float32)
            emb[key] -= step * 40 * (shares.T @ down)
    model = Model(names, emb @ lin, bias, 1.0, 0.0)
    z = np.array([w @ model.table[g] + bias for g, w, *_ in held])
    y = np.array([c for _, _, c, _ in held])
    losses = []
    for t in (grid := np.geomspace(0.05, 4, 40)):
        model.temperature = float(t)
        losses.append(-np.log(model.probabilities(z)[np.arange(len(y)), y] + 1e-12).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    p = model.probabilities(z)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.reject_below = float(np.quantile(right, 1 - accept)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on at most ``sample`` of docs(doc_id, text, lang), the first by a hash of doc_id; None without a labelled
    text. Rows with a null text or language, or without a letter, teach nothing."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = rows.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    order = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    picked = rows.where(order < int(share * (1 << 30))).select("doc_id", "text", "lang").orderBy(order, "doc_id", "text", "lang").limit(sample)
    found = sorted(picked.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))
    return train([r.text for r in found], [r.lang for r in found]) if found else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs but text, then lang_pred, score and rejected for every row; they replace columns of docs
    with those names.

    A null text or one without a letter gives 'und' and score 0, and counts as rejected; so does any text if nothing
    could be learned. Whole texts are read, of any length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: BUCKETS x languages

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            held: list[bytes] = []
            rows: list[int] = []
            size = 0
            for i, text in enumerate(texts):
                if m is not None and text and has_letter(text):
                    held.append(prepared(text))
                    rows.append(i)
                    size += len(held[-1])
                if rows and (size >= CHUNK or i == len(texts) - 1):
                    p = m.probabilities(m.logits(held))
                    best = p.argmax(axis=1)
                    scores[rows] = p[np.arange(len(rows)), best]
                    rejected[rows] = scores[rows] < m.reject_below
                    for k, b in zip(rows, best, strict=True):
                        langs[k] = m.langs[b]
                    held, rows, size = [], [], 0
            kept = {n: batch.column(n) for n in batch.schema.names if n in names}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores), "rejected": pa.array(rejected)})

    names = kept_names(docs, *RESULTS)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)
    return docs.mapInArrow(predicted, kept + "lang_pred string, score double, rejected boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
