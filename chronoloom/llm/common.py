"""Helpers shared by the corpus operators: shared tables, binary packing, hashing."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the word contracts (bytes.split() uses the same six).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: one batch of very long texts has to fit beside its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local one if the
    master is local, too; else an error, as executors would write where nobody else can read."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written: nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """materialize, with the rows bucketed by a key: what groups or joins by it later doesn't move them again."""
    spark, name = df.sparkSession, f"chronoloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    with shuffles_dropped(spark):
        df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what materialize wrote of frames that nothing reads any more."""
    for df in frames:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pack(*arrays: np.ndarray) -> bytes:
    """Numpy vectors as one compressed value; bytes of equal weight are put together, which compresses better."""
    head = [struct.pack("<I", len(arrays))]
    for a in arrays:
        head.append(a.dtype.str.encode().ljust(4) + struct.pack("<Q", a.nbytes))
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*head, *planes]))


def slim(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the smallest type that holds them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max))


def deltas(a: np.ndarray) -> np.ndarray:
    """Ascending whole numbers as steps from one to the next, which compress better; np.cumsum takes them back."""
    return slim(np.diff(a, prepend=a.dtype.type(0)))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, found = struct.unpack_from("<I", raw)[0], 4, []
    for _ in range(n):
        found.append((raw[at : at + 4].decode().strip(), struct.unpack_from("<Q", raw, at + 4)[0]))
        at += 12
    out = []
    for kind, size in found:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(width, size // width)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits. Works in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kept_names(docs: DataFrame, *results: str) -> list[str]:
    """Columns of docs but text and those that results with the same name (upper or lower case) replace."""
    return [c for c in docs.columns if c.lower() not in ("text", *results)]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(n)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
