"""Sources, sinks and runs of streaming queries.

A query's offsets are in its checkpoint and its sinks are keyed by batch number, so a batch that is done twice after a
failure leaves the same table: input counts as read only once what it led to is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import floor_div
from ..sources.archive import latest
from ..storage import exists, put, scratch, written

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Custom state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_source(spark: SparkSession, path: str, schema: T.StructType | str, files: int = 1) -> DataFrame:
    """Parquet files as they come, from the first on, ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


PART_ROWS, FILE_ROWS = 1_000_000, 50_000


def arrived_in_parts(rows: DataFrame, order: str, parts: int = 4) -> tuple[str, int]:
    """rows as files that came one part after another, for tests and replays: their folder, and the files of a part.

    There are more parts where rows are many, and a part has as many files as its rows ask for, written by as many
    tasks. Parts are ranges of ``order``. Rows are made once and dealt out to parts in one pass, so the work grows with
    the rows, not with rows times parts."""
    spark = rows.sparkSession
    path, dealt = scratch(spark), scratch(spark)
    held = written(rows)
    lo, hi, n = held.agg(F.min(order), F.max(order), F.count("*")).first()
    if n == 0:
        rows.write.parquet(path)
        return path, 1
    parts = max(parts, n // PART_ROWS)
    files = max(1, n // parts // FILE_ROWS)
    step = (hi - lo) // parts + 1
    put(held.withColumn("a_part", floor_div(F.col(order) - lo, step).cast("int")), dealt, "a_part")
    for i in range(parts):
        if exists(spark, f"{dealt}/a_part={i}"):
            put(spark.read.schema(rows.schema).parquet(f"{dealt}/a_part={i}").repartition(files), path)
    return path, files


Sink = Callable[[DataFrame, int], None]


def run_to_end(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> None:
    """Handle all that is there, in batches; start again with the same checkpoint to go on."""
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to(path: str) -> Sink:
    """Each batch in a folder of its own, overwritten if the batch is repeated."""

    def sink(df: DataFrame, batch: int) -> None:
        put(df, f"{path}/batch_id={batch}", mode="overwrite")

    return sink


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table with batch_id, and return that."""
    spark = stream.sparkSession
    path, schema = scratch(spark), stream.schema
    run_to_end(stream, append_to(path), scratch(spark), mode)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def newest(table: DataFrame, *keys: str) -> DataFrame:
    """The last written row of each key of a collected table."""
    return latest(table, keys, "batch_id").drop("batch_id")
