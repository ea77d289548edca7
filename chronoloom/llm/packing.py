"""Packing documents into sequences of bounded length by the sum-of-squares rule.

An open sequence has a gap, the room left in it. Each piece goes where the sum over gaps of (open sequences with that
gap) squared becomes smallest; that keeps all gaps in supply, so few sequences stay unfilled. Pieces are dealt out
at random into groups of a bounded number of rows, each packed in one task; a group leaves at most a few unfilled
sequences, whatever the size of the corpus. Full pieces are sequences of their own and take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, tune
from .tokens import default_path, encoder

CAPACITY, GROUP = 2048, 20_000


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; every length is between 1 and capacity.

    Longer pieces go first. Pieces of up to half the capacity open a sequence only where none has room for them:
    the order is known to end with the small pieces, so a supply of gaps is of no more use by then."""
    order = np.argsort(-lengths, kind="stable")
    open_with = np.zeros(capacity + 1, np.int64)  # by gap; full sequences don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    never = np.iinfo(np.int64).max
    for i, s in zip(order.tolist(), lengths[order].tolist(), strict=True):
        have = open_with[s:capacity]
        change = 2 * (open_with[: capacity - s] - have) + 2
        best_gap, best = capacity, (2 * int(open_with[capacity - s]) + 1 if s < capacity else 0)
        if len(have):
            change[0] = 1 - 2 * int(have[0])  # an exact fit closes the sequence
            change[have == 0] = never
            g = int(change.argmin())
            if change[g] < never and (change[g] <= best or 2 * s <= capacity):
                best_gap = s + g
        if best_gap == capacity:
            number, at = used, 0
            used += 1
        else:
            number, at = stacks[best_gap].pop(), capacity - best_gap
            open_with[best_gap] -= 1
        sequence[i], offset[i] = number, at
        if gap := best_gap - s:
            stacks[gap].append(number)
            open_with[gap] += 1
    return sequence, offset


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids: each document's ids and the end id, cut only where longer than capacity."""
    tune(docs.sparkSession)
    cut = _cut(tokenizer or default_path(), end_id, capacity)
    return _rows(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids array<int>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _cut(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            ids = [np.append(encode(t), end) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in ids], np.int64)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(ids)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            flat = np.concatenate(ids).astype("<i4") if ids else np.empty(0, "<i4")
            bounds = pa.array(np.append(0, np.cumsum(length)).astype("<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype("<i4")), pa.array(start), pa.array(length), pa.ListArray.from_arrays(bounds, pa.array(flat))],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return cut


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column("ids")
        bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kept = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length")}
        yield pa.RecordBatch.from_pydict(kept | {"ids_crc32": pa.array(crcs, pa.int64()), "p_row": pa.array(row + np.arange(len(crcs)))})
        row += len(crcs)


def digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces with the crc32 of each piece's ids in their place, and a number for each row. Both steps run in
    one Python worker, so a task holds one encoder."""
    tune(docs.sparkSession)
    cut = _cut(tokenizer or default_path(), end_id, capacity)
    return _rows(docs).mapInArrow(lambda batches: _digested(cut(batches)), "doc_id long, piece int, start long, length long, ids_crc32 long, p_row long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """All columns of pieces (with length and a distinct p_row), sequence_id and offset. pieces must be a written table."""
    full = pieces.where(F.col("length") == capacity).select("*", (F.lit(1 << 62) + F.col("p_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    out = rest.schema.add("sequence_id", "long").add("offset", "long")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        number = pdf.pop("p_group").iloc[0]
        pdf = pdf.sort_values("p_row", kind="stable")
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(int(number) << 32) + sequence, offset=offset)

    dealt = rest.withColumn("p_group", F.pmod(F.xxhash64("p_row"), F.lit(groups)))
    return full.unionByName(dealt.groupBy("p_group").applyInPandas(packed, out))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text).

    A null or empty text is its end id. Rows with equal or null ids are packed as rows of their own."""
    return pack_pieces(materialize(digest(docs, capacity=capacity)), capacity).drop("p_row")


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, length, ids: the packed sequences themselves."""
    pieces = token_pieces(docs, capacity=capacity).withColumn("p_row", F.monotonically_increasing_id())
    packed = pack_pieces(materialize(pieces), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
