"""Units: rows packed into compressed values of bounded size, for jobs that go back and forth over whole texts.

A job sends, from every unit, what it has to know about its keys (packed vectors, dealt out by bucket of the key),
meets all units' vectors of a bucket in one task, and sends answers back to the units. Keys that repeat in a unit
travel once, so a frequent key costs a bucket one entry per unit and not one per row.

Parcels are as many as units times buckets. Units and buckets therefore both stand for an amount of text that grows
with the root of all text (``side``), so parcels grow in proportion to the text and each stands for PARCEL_TEXT of it.
Where a side reaches what a task may hold, it stays there and parcels get smaller instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize_bucketed, tune

BYTES, ROWS = 4 << 20, 50_000  # text and rows of a unit
PARCEL_TEXT = 1 << 17


def text_of(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def side(total: int, least: int, most: int) -> int:
    """Text of a unit or bucket, so that there is a parcel for each PARCEL_TEXT of text."""
    return min(most, max(least, math.isqrt(total * PARCEL_TEXT)))


def _ipc(held: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in held:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _built(text: str, most: int, encode: Callable[[list[pa.RecordBatch]], bytes]):
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0

        def unit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"unit": pa.array([number], pa.int64()), "text_bytes": pa.array([size], pa.int64()), "blob": pa.array([encode(held)], pa.binary())})

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
            start = 0
            for i, n in enumerate(lengths):
                size += n
                rows += 1
                if size >= most or rows >= ROWS:
                    held.append(batch.slice(start, i + 1 - start))
                    yield unit()
                    number, held, size, rows, start = number + 1, [], 0, 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if rows:
            yield unit()

    return built


def units(docs: DataFrame, text: str = "text", most: int = BYTES, encode: Callable[[list[pa.RecordBatch]], bytes] = _ipc) -> DataFrame:
    """unit, text_bytes, blob: all rows and columns of docs, up to about ``most`` bytes of text in a unit; a written
    table, bucketed by unit, so that answers come to the units and units never move. ``encode`` makes a unit's blob."""
    tune(docs.sparkSession)
    buckets = min(50_000, max(16, 2 * docs.rdd.getNumPartitions()))
    return materialize_bucketed(docs.mapInArrow(_built(text, most, encode), "unit long, text_bytes long, blob binary"), "unit", buckets)


def rows_of(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def buckets_for(total: int, text_bytes: int) -> int:
    """So many buckets that each stands for about ``text_bytes`` of text."""
    return max(8, -(-total // text_bytes))


PARCEL = "bucket int, unit long, blob binary"


def send(made: DataFrame, parcels: Callable[[int, Any], Iterator[tuple[int, bytes]]], load: Callable[[bytes], Any] = rows_of) -> DataFrame:
    """parcels(unit, rows) of every unit, as rows (bucket, unit, blob)."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, blob in zip(batch.column("unit").to_pylist(), batch.column("blob"), strict=True):
                yield _parcels(unit, parcels(unit, load(blob.as_py())))

    return made.select("unit", "blob").mapInArrow(sent, PARCEL)


def _parcels(unit: int, found: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "unit": pa.array([unit] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})


def meet(parcels: DataFrame, answer: Callable[[list[bytes]], tuple[list[bytes | None], list[int]]], totals: int) -> DataFrame:
    """answer(blobs of a bucket) -> (an answer for each blob or None, ``totals`` numbers to sum up, and maybe a blob
    about the bucket): rows (bucket, unit, blob), and one row with a null unit, that blob and the numbers in ``totals``."""

    def met(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        blobs, numbers, *about = answer(table.column("blob").to_pylist())
        keep = [i for i, b in enumerate(blobs) if b is not None]
        bucket, ids = table.column("bucket")[0].as_py(), table.column("unit").to_pylist()
        return pa.table({
            "bucket": pa.array([bucket] * (len(keep) + 1), pa.int32()),
            "unit": pa.array([*(ids[i] for i in keep), None], pa.int64()),
            "blob": pa.array([*(blobs[i] for i in keep), about[0] if about else None], pa.binary()),
            "totals": pa.array([*([None] * len(keep)), numbers], pa.list_(pa.int64())),
        })

    return parcels.groupBy("bucket").applyInArrow(met, PARCEL + ", totals array<long>")


def total(answers: DataFrame, n: int) -> list[int]:
    row = answers.where(F.col("unit").isNull()).agg(*(F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(n))).first()
    return [int(x) for x in row]


def back(made: DataFrame, answers: DataFrame, f: Callable[[int, Any, dict[tuple[int, int], bytes]], pa.Table], schema: str, load: Callable[[bytes], Any] = rows_of) -> DataFrame:
    """f(unit, rows, answers by (kind, bucket)) for every unit; answers: (kind, bucket, unit, blob)."""

    def came(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {(k, b): x for k, b, x in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True)}
        if left.num_rows == 0:
            return None
        return f(left.column("unit")[0].as_py(), load(left.column("blob")[0].as_py()), got)

    some = answers.where(F.col("unit").isNotNull()).select("kind", "bucket", "unit", "blob")
    return made.select("unit", "blob").groupBy("unit").cogroup(some.groupBy("unit")).applyInArrow(came, schema)


def parcels_table(unit: int, found: Iterator[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_parcels(unit, found)])


def split(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins in it (n + 1 bounds)."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))
