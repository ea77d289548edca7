"""Reading source files and packets into telemetry rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import lenient_bool, lenient_number, parse_time, unit_scale
from ..model import PACKET


@dataclass(frozen=True)
class Columns:
    """Names of a source's columns; nd and otkl may be missing."""

    channel: str = "id"
    ts: str = "ts"
    val: str = "val"
    nd: str = "nd"
    otkl: str = "otkl"


def map_source_columns(raw: DataFrame, names: Columns = Columns()) -> DataFrame:
    """channel, ts, val, nd, otkl as the source has them; missing flags are false and 0."""
    have = set(raw.columns)
    return raw.select(
        F.col(names.channel).cast("string").alias("channel"), F.col(names.ts).alias("ts"), F.col(names.val).alias("val"),
        (F.col(names.nd) if names.nd in have else F.lit(False)).alias("nd"), (F.col(names.otkl) if names.otkl in have else F.lit(0)).alias("otkl"),
    )


def coerce_flags(rows: DataFrame) -> DataFrame:
    """Values that aren't finite numbers become null, flags are read leniently, states that aren't numbers are 0."""
    return rows.select(
        "channel", "ts", lenient_number(F.col("val")).alias("val"), lenient_bool(F.col("nd")).alias("nd"),
        F.coalesce(F.col("otkl").cast("string").try_cast("double"), F.lit(0.0)).cast("int").alias("otkl"),
    )


def to_micros(rows: DataFrame) -> DataFrame:
    """ts in microseconds. Numbers are s, ms, us or ns by the magnitude of the source's largest; other text is ISO-8601."""
    number = F.col("ts").cast("string").try_cast("decimal(38,9)")
    largest = rows.select(F.max(F.abs(number)).cast("double").alias("t_largest"))
    scaled = F.rint(number.cast("double") * unit_scale(F.col("t_largest")))
    exact = F.when(F.col("t_largest").between(1e14, 1e17 - 1), number.cast("long")).otherwise(scaled.cast("long"))
    # one row: what the whole source's times look like
    return rows.crossJoin(F.broadcast(largest)).withColumn("ts", F.coalesce(exact, parse_time(F.col("ts").cast("string")))).drop("t_largest")


def read_telemetry(spark: SparkSession, path: str, names: Columns = Columns(), fmt: str = "auto") -> DataFrame:
    """CSV (plain or gzip, with a header) or Parquet files as telemetry rows; everything of a CSV is read as text."""
    fmt = ("parquet" if ".parquet" in path else "csv") if fmt == "auto" else fmt
    raw = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    return to_micros(coerce_flags(map_source_columns(raw, names)))


def read_channel(rows: DataFrame, channel: str) -> DataFrame:
    """One channel in time order, with what counts as valid."""
    valid = ~F.col("nd") & F.col("val").isNotNull()
    return rows.where(F.col("channel") == channel).select("channel", "ts", "val", valid.alias("valid")).orderBy("ts")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("id").alias("channel"), F.col("ts_start").cast("long").alias("ts_start"), F.col("ts_end").cast("long").alias("ts_end"), "type")


def parse_packet_json(lines: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Packets that can be read, and the lines that can't, with a reason."""
    parsed = F.from_json(body, PACKET + ", bad_record string", {"columnNameOfCorruptRecord": "bad_record"})
    rows = lines.withColumn("packet", parsed)
    broken = F.col("packet").isNull() | F.col("packet.bad_record").isNotNull() | F.col("packet.seq").isNull() | F.col("packet.channels").isNull()
    good = rows.where(~broken).withColumn("packet", F.col("packet").dropFields("bad_record"))
    return good, rows.where(broken).select(F.col(body).alias("line"), F.lit("not a packet").alias("error"))




def explode_packets(good: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of packets: seq, source, channel, pos, ts, val, nd, otkl; and the channels whose arrays don't match.

    A packet with such a channel is rejected as a whole."""
    bad = F.exists("packet.channels", lambda c: _mismatch(c))
    fine = good.where(~bad).select(*extra, "packet.seq", "packet.source", F.explode("packet.channels").alias("c"))
    n = F.size("c.ts")
    zipped = F.arrays_zip(
        F.col("c.ts").alias("ts"), F.col("c.val").alias("val"),
        F.coalesce("c.nd", F.array_repeat(F.lit(False), n)).alias("nd"), F.coalesce("c.otkl", F.array_repeat(F.lit(0), n)).alias("otkl"),
    )
    rows = fine.select(*extra, "seq", "source", F.col("c.id").alias("channel"), F.posexplode(zipped).alias("pos", "p"))
    rows = rows.select(*extra, "seq", "source", "channel", "pos", "p.ts", "p.val", "p.nd", "p.otkl")
    rejected = good.where(bad).select(F.col("packet.seq").alias("seq"), F.lit("lengths of arrays differ").alias("error"))
    return rows, rejected


def _mismatch(c: Column) -> Column:
    n = F.size(c["ts"])
    flags = (c["nd"].isNotNull() & (F.size(c["nd"]) != n)) | (c["otkl"].isNotNull() & (F.size(c["otkl"]) != n))
    return F.coalesce(c["ts"].isNull() | c["val"].isNull() | (F.size(c["val"]) != n) | flags, F.lit(True))


def export_slice(rows: DataFrame, path: str, t_from: int, t_to: int, channels: tuple[str, ...] = ()) -> None:
    """Gzip CSV files in one folder for each hour."""
    part = rows.where((F.col("ts") >= t_from) & (F.col("ts") < t_to))
    part = part.where(F.col("channel").isin(*channels)) if channels else part
    hour = F.date_format(F.timestamp_micros("ts"), "yyyyMMddHH")
    part.withColumn("hour", hour).write.partitionBy("hour").option("header", True).option("compression", "gzip").csv(path)
