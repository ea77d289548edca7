"""The engine's tables as views of the driver's tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import micros
from .functions.scalar import quality as quality_of
from .params import HOUR

REGISTRY = "channel string, unit string, x_min double, x_max double, hampel_window int, hampel_kappa double, hampel_min_sigma double, feature_window int, residual_k double, analytics_enabled boolean"
RULES = "rule_id int, channel string, kind string, limit double, deadband double, on_delay long, off_delay long, min_repeat long, priority int, enabled boolean"
PACKET = "seq long, source string, sent_at long, channels array<struct<id: string, ts: array<long>, val: array<double>, nd: array<boolean>, otkl: array<int>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(us: int) -> Column:
    """A time as the stored column has it, so that comparisons reach the Parquet scan."""
    return F.lit(datetime(1970, 1, 1) + timedelta(microseconds=us)).cast("timestamp_ntz")


def telemetry_source(spark: SparkSession, sf_dir: str, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    """channel, ts, val, nd, otkl, arrival, pkt and event_id, from events in [t_from, t_to)."""
    rows = table(spark, sf_dir, "events")
    rows = rows if t_from is None else rows.where(F.col("ts") >= instant(t_from))
    rows = rows if t_to is None else rows.where(F.col("ts") < instant(t_to))
    k = F.get_json_object("props", "$.k").cast("int")
    arrival = F.col("event_id") + F.when(F.col("event_id") % 97 == 0, 400).otherwise(0)
    return rows.select(
        F.col("event_type").alias("channel"), micros(F.col("ts")).alias("ts"), F.when(k != 3, F.col("value")).alias("val"), (k == 0).alias("nd"),
        F.when(k.isin(1, 2), k).otherwise(0).alias("otkl"), arrival.alias("arrival"), F.floor(arrival / 50).alias("pkt"), "event_id",
    )


def telemetry(spark: SparkSession, sf_dir: str, t_from: int | None = None, t_to: int | None = None, x_min: float = 0.5, x_max: float = 100.0) -> DataFrame:
    rows = telemetry_source(spark, sf_dir, t_from, t_to)
    return rows.withColumn("quality", quality_of(F.col("val"), F.col("nd"), F.col("otkl"), F.lit(x_min), F.lit(x_max)))


def registry(spark: SparkSession) -> DataFrame:
    rows = [(c, "u", 0.5, 100.0, 21 if c == "view" else None, 4.0 if c == "error" else None, None, None, None, True) for c in ("click", "error", "purchase", "view")]
    return spark.createDataFrame([*rows, ("ghost", "u", None, None, None, None, None, None, None, False)], REGISTRY)


def alarm_rules(spark: SparkSession) -> DataFrame:
    m = HOUR // 60
    return spark.createDataFrame(
        [
            (1, "click", "hi", 80.0, 20.0, 0, 0, 0, 1, True), (2, "error", "hihi", 60.0, 0.0, HOUR, HOUR, 0, 2, True),
            (3, "view", "lo", 5.0, 2.0, 10 * m, 0, 6 * HOUR, 1, True), (4, "purchase", "anomaly", None, 0.0, 0, 0, 0, 3, True),
            (5, "click", "lolo", 1.0, 0.0, 0, 0, 0, 1, False),
        ],
        RULES,
    )


def ack_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry_source(spark, sf_dir).where(F.col("event_id") % 500 == 7)
    return rows.select("ts", (1 + F.col("event_id") % 4).cast("int").alias("rule_id"), F.lit("operator").alias("user"))


def anomaly_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where((F.col("value") > 220) | (F.col("event_id") % 401 == 0))
    ts = micros(F.col("ts"))
    kind = F.element_at(F.array(F.lit("impulse"), F.lit("level_shift"), F.lit("drift")), (F.col("event_id") % 3 + 1).cast("int"))
    return rows.select(F.col("event_type").alias("channel"), ts.alias("ts_start"), (ts + HOUR).alias("ts_end"), kind.alias("type"), F.col("event_id").alias("label_id"))


def mode_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0))
    mode = F.element_at(F.array(F.lit("idle"), F.lit("work"), F.lit("service")), (F.col("event_id") % 3 + 1).cast("int"))
    return rows.select(F.concat(F.lit("r"), F.col("user_id") % 4).alias("robot"), mode.alias("mode"), micros(F.col("ts")).alias("ts"), F.col("event_id").alias("mode_id"))


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), (F.col("value") * 1000).cast("long").alias("us"))


def packets(rows: DataFrame) -> DataFrame:
    """Telemetry rows as one JSON packet for each pkt, rows in order of arrival."""
    point = F.struct("arrival", "ts", "val", "nd", "otkl")
    channels = rows.groupBy("pkt", "channel").agg(F.sort_array(F.collect_list(point)).alias("p"))
    part = lambda c: F.transform("p", lambda p: p[c]).alias(c)
    channel = F.struct(F.col("channel").alias("id"), part("ts"), part("val"), part("nd"), part("otkl"))
    body = F.struct(F.col("pkt").alias("seq"), F.lit("t").alias("source"), F.lit(0).cast("long").alias("sent_at"), F.col("channels"))
    grouped = channels.groupBy("pkt").agg(F.sort_array(F.collect_list(channel)).alias("channels"))
    return grouped.select("pkt", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
