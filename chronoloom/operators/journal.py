"""Queries of events, alarms, logs and modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.archive import in_range


def _of(rows: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col(column).isin(*names)) if names else rows


def newest_n(rows: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """The newest n rows; ties in a fixed order."""
    return rows.orderBy(F.desc(order), *ties).limit(n)


def events_in_range(events: DataFrame, t_from: int, t_to: int, run: str = "online", kinds: tuple[str, ...] = (), channels: tuple[str, ...] = (), limit: int = 500) -> DataFrame:
    """Events that overlap a range."""
    found = events.where((F.col("ts_end") >= t_from) & (F.col("ts_start") < t_to) & (F.col("run") == run))
    return newest_n(_of(_of(found, "kind", kinds), "channel", channels), "ts_start", limit, "channel", "kind")


def alarms_in_range(occurrences: DataFrame, t_from: int, t_to: int, states: tuple[str, ...] = (), limit: int = 500) -> DataFrame:
    found = occurrences.where((F.col("ts_active") < t_to) & (F.col("ts_return").isNull() | (F.col("ts_return") >= t_from)))
    found = found.withColumn("active", F.col("state") != "normal")
    return newest_n(_of(found, "state", states), "ts_active", limit, "rule_id", "occurrence")


def alarm_log_query(log: DataFrame, channels: tuple[str, ...] = (), limit: int = 500) -> DataFrame:
    return newest_n(_of(log, "channel", channels), "ts", limit, "rule_id", "transition")


def modes_in_range(modes: DataFrame, robot: str, t_from: int, t_to: int) -> DataFrame:
    return modes.where((F.col("robot") == robot) & in_range(t_from, t_to)).orderBy("ts")
