"""A stream without a state of its own: last values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_last_wm(rows: DataFrame) -> DataFrame:
    """Last value and watermark of each channel (complete or update mode): the newest of the last packet, even if an
    earlier packet had a newer time; the watermark is the newest of all."""
    last = F.max_by(F.struct("ts", "val"), F.struct("pkt", "ts", "arrival")).alias("p")
    return rows.groupBy("channel").agg(last, F.max("ts").alias("watermark")).select("channel", "p.ts", "p.val", "watermark")
