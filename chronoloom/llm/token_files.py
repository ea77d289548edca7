"""Token ids in ORC: integer run-length encoded ids, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id, so part files, stripes and row groups hold ascending ids: a look-up
by doc_id skips stripes by their statistics, then row groups by index and Bloom filter, and stripes are read in
parallel. Each row stores its part number and its start inside the part; the start in the whole corpus is that
plus the tokens of the parts before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_folder, tune
from .tokens import default_path, encoder

ROWS = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encoded(path: str, end_id: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids = [np.append(encode(t), end) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            flat = np.concatenate(ids).astype("<i4") if ids else np.empty(0, "<i4")
            bounds = pa.array(np.append(0, np.cumsum(sizes)).astype("<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ids), part, "<i4")), pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(bounds, pa.array(flat))],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )

    return encoded


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, stripe_mb: int = 64, row_group: int = 1000) -> None:
    """Write docs(doc_id, text) in ascending doc_id order (null first; equal ids by text). A null text has the end id alone."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the hash keeps rows of one id apart if there are too many of them, in an order that stays ascending
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    (
        ranged.mapInArrow(_encoded(tokenizer or default_path(), end_id), ROWS).write.format("orc")
        .option("compression", "zstd").option("orc.stripe.size", stripe_mb << 20).option("orc.row.index.stride", row_group)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").save(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. A filter on doc_id reaches the ORC reader."""
    rows = spark.read.schema(ROWS).orc(path)
    # a row for each part file: one sum over the small columns gives where each part begins
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names if n != "ids"} | {"ids_crc32": pa.array(crcs, pa.int64())})


def with_crc(df: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "ids")
    return df.mapInArrow(_crcs, rest + ", ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path)
    return with_crc(read_tokens(spark, path))
