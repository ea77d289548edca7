"""Scans of stored tables and the sinks that fill them."""

from __future__ import annotations

from dataclasses import asdict
from decimal import Decimal
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.models import NAIVE, by_channel
from ..params import DAY, SECOND, ChannelParams

if TYPE_CHECKING:
    from .stored import Stored

WEEK = 7 * DAY
UNITS = {"s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND, "d": DAY, "w": WEEK}


def in_range(t_from: int | None, t_to: int | None, ts: str = "ts") -> Column:
    """Half-open range; either end may be open."""
    out = F.lit(True)
    out = out & (F.col(ts) >= t_from) if t_from is not None else out
    return out & (F.col(ts) < t_to) if t_to is not None else out


def scan_raw(archive: DataFrame, channel: str, t_from: int, t_to: int, limit: int | None = None) -> DataFrame:
    out = archive.where((F.col("channel") == channel) & in_range(t_from, t_to)).select("channel", "ts", "val", "quality")
    return out if limit is None else out.orderBy("ts").limit(limit)


def scan_raw_good(archive: DataFrame, channel: str, t_from: int, t_to: int) -> DataFrame:
    return archive.where((F.col("channel") == channel) & in_range(t_from, t_to) & (F.col("quality") != "bad")).select("channel", "ts", "val")


def scan_agg(buckets: DataFrame, channel: str, level: int, t_from: int, t_to: int) -> DataFrame:
    return buckets.where((F.col("channel") == channel) & (F.col("lvl") == level) & in_range(t_from, t_to)).orderBy("ts")


def scan_flags(flags: DataFrame, channels: tuple[str, ...], t_from: int, t_to: int, run: str = "online", limit: int | None = None) -> DataFrame:
    found = flags.where(F.col("channel").isin(*channels) & (F.col("run") == run) & in_range(t_from, t_to)).orderBy("ts", "channel")
    return found if limit is None else found.limit(limit)


def filter_telemetry(rows: DataFrame, channels: tuple[str, ...] = (), t_from: int | None = None, t_to: int | None = None) -> DataFrame:
    rows = rows.where(in_range(t_from, t_to))
    return rows.where(F.col("channel").isin(*channels)) if channels else rows


def last_period(rows: DataFrame, period: str, end: int | None = None) -> DataFrame:
    """The newest 30s, 30m, 1.5h, 2d or 1w; without an end, up to the last row."""
    length = round(Decimal(period[:-1]) * UNITS[period[-1]])
    if end is not None:
        return rows.where(in_range(end - length, end))
    last = rows.agg((F.max("ts") + 1).alias("t_end"))  # one row
    return rows.crossJoin(F.broadcast(last)).where((F.col("ts") >= F.col("t_end") - length) & (F.col("ts") < F.col("t_end"))).drop("t_end")


def latest(rows: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """Merge on read: the last written row of each key."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return rows.withColumn("v_number", number).where("v_number = 1").drop("v_number")


def upsert_telemetry(rows: DataFrame, table: Stored, batch_id: int) -> None:
    """Rows of one batch into a stored table, of those with one key the last that arrived."""
    table.upsert(latest(rows, table.keys, "arrival"), batch_id)


def sparse_flags(rows: DataFrame) -> DataFrame:
    """Flags worth storing; numbers that aren't finite are left out as nulls."""
    keep = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    return rows.where(F.col("substituted") | F.col("anomaly")).select(*keep)


def event_rows(episodes: DataFrame, run: str, p: ChannelParams = ChannelParams(), models: DataFrame | None = None) -> DataFrame:
    """Episodes as events of a run. Details are a JSON of the episode's numbers, the parameters of the run and the model
    that judged the channel (that of ``models``, a model table; else the naive forecast)."""
    if models is None:
        rows = episodes.withColumn("model_version", F.lit(NAIVE.version))
    else:
        versions = by_channel(models).select("channel", F.col("m_version").alias("model_version"))
        rows = episodes.join(versions, "channel", "left").fillna(NAIVE.version, ["model_version"])
    params = F.struct(*(F.lit(v).alias(k) for k, v in asdict(p).items() if k != "chunk"))  # how rows are dealt out is no parameter of a run
    details = F.to_json(F.struct("n_points", "peak_value", "score", F.col("model_version").alias("model"), params.alias("params")))
    return rows.select("channel", "kind", "ts_start", "ts_end", "n_points", "peak_ts", "peak_value", "score", F.lit(run).alias("run"), "model_version", details.alias("details"))


def notifications(rows: DataFrame, topic: str = "flags", subscribed: tuple[str, ...] | None = None) -> DataFrame:
    """key, topic (flags, events or alarms), value: one JSON message for each row of a channel somebody subscribed to."""
    rows = rows if subscribed is None else rows.where(F.col("channel").isin(*subscribed))
    return rows.select(F.col("channel").alias("key"), F.lit(topic).alias("topic"), F.to_json(F.struct(*rows.columns)).alias("value"))


def export_raw(rows: DataFrame) -> DataFrame:
    """The columns of an export, in order."""
    return rows.select("channel", "ts", "val", "quality", "nd", "otkl").orderBy("channel", "ts")
