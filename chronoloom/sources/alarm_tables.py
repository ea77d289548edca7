"""Alarm tables: the append-only log and the occurrences that it updates, written by batches.

A batch writes to two folders, each under its own number: the log's rows, and those occurrences that they began or
changed, as they are afterwards. A batch that is repeated reads what earlier batches left and overwrites its own
folders, so it changes nothing. ``occurrences`` reads the last version of each; ``compact`` puts all versions up to a
batch into one file set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.alarms import LOG, NORMAL, calling
from ..storage import exists, put
from .archive import latest

OCCURRENCE = "rule_id int, occurrence long, channel string, state string, ts_active long, ts_on long, ts_return long, ts_ack long, acked_by string, value double"
KEYS = ("rule_id", "occurrence")


def numbered(log: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """Log rows with their occurrence: an activation from normal begins one, and so does a rule's first row. ``newest``
    (rule_id, occurrence) is what earlier batches have reached."""
    rank = F.when(F.col("transition") == "acknowledged", 1).otherwise(0)
    opens = F.when((F.col("transition") == "activated") & (F.col("state_from") == NORMAL), 1).otherwise(0)
    so_far = Window.partitionBy("rule_id").orderBy("ts", "o_rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("o_rank", rank).withColumn("o_open", opens)
    if newest is None:
        rows = rows.withColumn("o_before", F.lit(0))
    else:
        rows = rows.join(newest.select("rule_id", F.col("occurrence").alias("o_before")), "rule_id", "left").fillna(0, ["o_before"])
    number = F.greatest(F.col("o_before") + F.sum("o_open").over(so_far), F.lit(1))
    return rows.withColumn("occurrence", number.cast("long")).drop("o_open", "o_before")


def changed(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Occurrences that numbered log rows begin or change; ``before``: occurrences as they were."""
    at = F.struct("ts", "o_rank")
    acked = F.col("transition") == "acknowledged"
    on = F.col("transition") == "activated"
    turn = F.max_by(F.struct(F.when(F.col("transition") == "returned", F.col("ts")).alias("t")), F.when(~acked, at))
    parts = rows.groupBy(*KEYS).agg(
        F.first("channel").alias("channel"), F.max_by("state_to", at).alias("state"), F.min("ts").alias("n_active"), F.max(F.when(on, F.col("ts"))).alias("n_on"), turn.alias("n_turn"),
        F.max(F.when(acked, F.col("ts"))).alias("n_ack"), F.max_by("user", F.when(acked, at)).alias("n_user"), F.min_by(F.struct("value"), at).alias("n_value"),
    )
    old = before.select(*KEYS, F.struct("ts_active", "ts_on", "ts_return", "ts_ack", "acked_by", "value").alias("b"))
    both = parts.join(old, list(KEYS), "left")
    known, b = F.col("b").isNotNull(), lambda c: F.col("b." + c)
    return both.select(
        *KEYS, "channel", "state", F.when(known, b("ts_active")).otherwise(F.col("n_active")).alias("ts_active"), F.coalesce("n_on", b("ts_on")).alias("ts_on"),
        F.when(F.col("n_turn").isNotNull(), F.col("n_turn.t")).otherwise(b("ts_return")).alias("ts_return"), F.coalesce("n_ack", b("ts_ack")).alias("ts_ack"),
        F.when(F.col("n_ack").isNotNull(), F.col("n_user")).otherwise(b("acked_by")).alias("acked_by"), F.when(known, b("value")).otherwise(F.col("n_value.value")).alias("value"),
    )


def _versions(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    """Versions of occurrences, of batches before a number only."""
    if not exists(spark, f"{path}/occurrences"):
        return spark.createDataFrame([], OCCURRENCE + ", batch_id long")
    rows = spark.read.schema(OCCURRENCE + ", batch_id long").parquet(f"{path}/occurrences")
    return rows if before is None else rows.where(F.col("batch_id") < before)


def occurrences(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table of occurrences: rule_id, occurrence, channel, state, ts_active (its begin), ts_on (its last activation),
    ts_return, ts_ack, acked_by, value."""
    return latest(_versions(spark, path, before), KEYS, "batch_id").drop("batch_id")


def alarm_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored log with each row's occurrence."""
    if not exists(spark, f"{path}/log"):
        return spark.createDataFrame([], LOG + ", occurrence long, batch_id long")
    return spark.read.schema(LOG + ", occurrence long, batch_id long").parquet(f"{path}/log")


def newest_of_rules(table: DataFrame, *version: str) -> DataFrame:
    """The newest occurrence of each rule, of several versions the last: a row a rule."""
    columns = [c for c in table.columns if c != "rule_id"]
    return table.groupBy("rule_id").agg(F.max_by(F.struct(*columns), F.struct("occurrence", *version)).alias("o")).select("rule_id", "o.*")


def write_alarm_tables(log: DataFrame, path: str, batch_id: int) -> None:
    """Log rows of one batch (each rule's in order of time, after those of earlier batches) into both tables. The log is
    read once, as a stream would run its batch again for every reading."""
    spark = log.sparkSession
    newest = newest_of_rules(_versions(spark, path, batch_id), "batch_id").drop("batch_id")
    folder = f"batch_id={batch_id}"
    put(numbered(log, newest).drop("o_rank"), f"{path}/log/{folder}", mode="overwrite")
    stored = spark.read.schema(LOG + ", occurrence long").parquet(f"{path}/log/{folder}")
    rank = F.when(F.col("transition") == "acknowledged", 1).otherwise(0)
    put(changed(stored.withColumn("o_rank", rank), newest), f"{path}/occurrences/{folder}", mode="overwrite")


def alarm_sink(path: str):
    """write_alarm_tables as the sink of a stream."""
    return lambda df, batch: write_alarm_tables(df, path, batch)


def compact(spark: SparkSession, path: str, target: str, upto: int) -> None:
    """The table after a batch as one folder under a new path, with that batch's number; later batches go on there."""
    put(occurrences(spark, path, upto + 1), f"{target}/occurrences/batch_id={upto}", mode="overwrite")


def initial_state(table: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """rule_id, state, condition, last_on, called of each rule with an occurrence, for a stream that goes on without the
    checkpoint of the one that wrote the table: the newest occurrence gives the state, whether the condition is on, and
    when it turned on last.

    A change that readings had called for but that wasn't due yet is known from ``readings`` (those before the new
    stream's first, with their rule's columns, of rules without occurrences, too): ``called`` is the first of the
    readings since the last turn that have called for it without a break. Without readings such a change starts anew."""
    last = newest_of_rules(table)
    on = F.col("state").isin("unack_active", "ack_active")
    known = last.select("rule_id", "state", on.alias("condition"), F.col("ts_on").alias("last_on"), F.greatest("ts_on", "ts_return").alias("s_turn"))
    if readings is None:
        return known.select("rule_id", "state", "condition", "last_on", F.lit(None).cast("long").alias("called"))
    rows = readings.join(known, "rule_id", "left").where(F.col("s_turn").isNull() | (F.col("ts") > F.col("s_turn")))
    calls = calling(~F.coalesce("condition", F.lit(False)))
    rows = rows.select("rule_id", "ts", calls.alias("s_calls"))
    border = rows.where(~F.col("s_calls")).groupBy("rule_id").agg(F.max("ts").alias("s_last"))
    since = rows.where("s_calls").join(border, "rule_id", "left").where(F.col("s_last").isNull() | (F.col("ts") > F.col("s_last")))
    called = since.groupBy("rule_id").agg(F.min("ts").alias("called"))
    return known.join(called, "rule_id", "full").select("rule_id", F.coalesce("state", F.lit(NORMAL)).alias("state"), F.coalesce("condition", F.lit(False)).alias("condition"), "last_on", "called")
