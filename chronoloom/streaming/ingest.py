"""Ingest of packets with acknowledgements and registration of channels.

A micro-batch of packet lines has four outputs, each in a folder under the batch's number: rows, acks, channels seen for
the first time, and lines that aren't packets. What is known of channels is the registry and what earlier batches have
registered, so a batch that is repeated reads the same and overwrites its own folders: it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import dedup_last, packet_ack, quality_with_registry, register_new_channels
from ..params import TS_MAX, TS_MIN
from ..sources.files import explode_packets, parse_packet_json
from ..storage import exists, put, written

ROWS = "seq long, source string, channel string, pos int, ts long, val double, nd boolean, otkl int, quality string, t_ing long, batch_id long"
ACKS = "pkt long, accepted long, rejected long, reordered long, errors array<string>, new_channels array<string>, batch_id long"
CHANNELS = "channel string, batch_id long"
BROKEN = "line string, error string, batch_id long"
OUTPUTS = {"rows": ROWS, "acks": ACKS, "channels": CHANNELS, "broken": BROKEN}


def stored(spark: SparkSession, path: str, output: str, before: int | None = None) -> DataFrame:
    """One of the outputs, of all batches or of those before a number."""
    found = f"{path}/{output}"
    table = spark.read.schema(OUTPUTS[output]).parquet(found) if exists(spark, found) else spark.createDataFrame([], OUTPUTS[output])
    return table if before is None else table.where(F.col("batch_id") < before)


def registered(registry: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """The registry with the channels that batches have added; one that is there is on."""
    return register_new_channels(registry, stored(registry.sparkSession, path, "channels", before))


def ingest_batch(lines: DataFrame, registry: DataFrame, path: str, batch_id: int, ingested: Column | None = None, every: bool = False) -> None:
    """Packets of one micro-batch (a column ``body``) into all outputs.

    Equal lines of a batch are one packet. Lines that can't be read, and packets with arrays of different lengths, go to
    ``broken`` and have no ack. A packet's batch of a channel with a time outside 2000 to 2100 is rejected as a whole; of
    equal times in a packet the last counts or, for sources that have several readings at one time, ``every`` one: a
    row's place in its packet (pos) tells them apart. A channel is new in the first packet that names it, even without
    rows."""
    spark = lines.sparkSession
    good, unread = parse_packet_json(lines.select("body").distinct())
    good = written(good)
    rows, uneven = explode_packets(good)
    named = good.join(uneven.select("seq").distinct(), good["packet.seq"] == F.col("seq"), "left_anti").select(F.col("packet.seq").alias("pkt"), F.explode_outer("packet.channels.id").alias("channel"))
    known = written(registered(registry, path, batch_id))

    def out(df: DataFrame, name: str) -> None:
        put(df, f"{path}/{name}/batch_id={batch_id}", mode="overwrite")

    numbered = rows.withColumnRenamed("seq", "pkt")
    out(packet_ack(numbered, known, named, every), "acks")
    out(named.where(F.col("channel").isNotNull()).select("channel").distinct().join(known.select("channel"), "channel", "left_anti"), "channels")
    out(unread.select("line", "error").unionByName(uneven.select(F.col("seq").cast("string").alias("line"), "error")), "broken")
    extremes = rows.groupBy("seq", "channel").agg(F.min("ts").alias("r_lo"), F.max("ts").alias("r_hi")).where((F.col("r_lo") < TS_MIN) | (F.col("r_hi") > TS_MAX))
    fine = rows.join(extremes.select("seq", "channel"), ["seq", "channel"], "left_anti")
    kept = fine if every else dedup_last(fine, "seq", "channel", "ts", order=("pos",))
    stamp = F.unix_micros(F.current_timestamp()) if ingested is None else ingested
    stamped = quality_with_registry(kept, known).withColumn("t_ing", stamp)
    out(stamped.select(*(c.split()[0] for c in ROWS.split(", ")[:-1])), "rows")


def ingest_sink(registry: DataFrame, path: str, every: bool = False):
    """ingest_batch as the sink of a stream of lines."""
    return lambda df, batch: ingest_batch(df, registry, path, batch, every=every)
