"""Ingest of packets: checks, order, quality, acknowledgements, last values, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quality
from ..params import TS_MAX, TS_MIN, ChannelParams
from . import prefix


def quality_with_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Quality of each row by its channel's limits; no limits for an unknown channel."""
    limits = registry.select("channel", "x_min", "x_max")
    joined = rows.join(limits, "channel", "left")
    code = quality(F.col("val"), F.col("nd"), F.col("otkl"), F.col("x_min"), F.col("x_max"))
    return joined.withColumn("quality", code).drop("x_min", "x_max")


def timestamps_ok() -> Column:
    """Of a packet's batch of one channel: all its times are between 2000 and 2100."""
    batch = Window.partitionBy("pkt", "channel")
    return (F.min("ts").over(batch) >= TS_MIN) & (F.max("ts").over(batch) <= TS_MAX)


def reject_bad_timestamps(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ok", timestamps_ok()).where("ok").drop("ok")


def dedup_last(rows: DataFrame, *keys: str, order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """One row for each key, the one that arrived last."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("k_number", F.row_number().over(newest)).where("k_number = 1").drop("k_number")


def packet_ack(rows: DataFrame, known: DataFrame, named: DataFrame | None = None, every: bool = False) -> DataFrame:
    """pkt, accepted, rejected, reordered, errors and new_channels (sorted lists). rows: pkt, channel, pos, ts; named:
    (pkt, channel) of packets, if they also name channels without rows (null: a packet without channels).

    A channel batch with a bad time is rejected as a whole, with an error; one whose times go down is counted as
    reordered as a whole; of equal times the last counts, or ``every`` one. A channel that isn't known is new in the
    first packet that has it, which registers it."""
    batch = Window.partitionBy("pkt", "channel")
    down = F.col("ts") < F.lag("ts").over(batch.orderBy("pos"))
    marked = rows.withColumn("down", F.coalesce(down, F.lit(False)))
    per = marked.groupBy("pkt", "channel").agg(
        F.count("*").alias("n"), (F.count("*") if every else F.count_distinct("ts")).alias("n_times"), F.max("down").alias("disordered"), ((F.min("ts") < TS_MIN) | (F.max("ts") > TS_MAX)).alias("bad"),
    )
    if named is not None:
        per = named.distinct().join(per, ["pkt", "channel"], "left").fillna(0, ["n", "n_times"]).fillna(False, ["disordered", "bad"])
    first = (rows if named is None else named).groupBy("channel").agg(F.min("pkt").alias("pkt")).join(known.select("channel"), "channel", "left_anti").withColumn("is_new", F.lit(True))
    per = per.join(first, ["channel", "pkt"], "left")
    good = ~F.col("bad")
    listed = lambda c: F.sort_array(F.collect_list(c))
    return per.groupBy("pkt").agg(
        F.sum(F.when(good, F.col("n_times")).otherwise(0)).alias("accepted"),
        F.sum(F.when(good, F.col("n") - F.col("n_times")).otherwise(F.col("n"))).alias("rejected"),
        F.sum(F.when(good & F.col("disordered"), F.col("n")).otherwise(0)).alias("reordered"),
        listed(F.when(F.col("bad"), F.concat("channel", F.lit(": times out of range")))).alias("errors"),
        listed(F.when(F.col("is_new"), F.col("channel"))).alias("new_channels"),
    )


def last_values(rows: DataFrame) -> DataFrame:
    """The last value of each channel: the newest row of its last packet (of equal times the last to arrive), even if
    an earlier packet had a newer time."""
    last = F.max_by(F.struct("ts", "val", "quality"), F.struct("pkt", "ts", "arrival")).alias("p")
    return rows.groupBy("channel").agg(last).select("channel", "p.ts", "p.val", "p.quality")


def channel_watermark(rows: DataFrame) -> DataFrame:
    return rows.groupBy("channel").agg(F.max("ts").alias("watermark"))


def register_new_channels(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """The registry with unknown channels of rows added."""
    new = rows.select("channel").distinct().join(registry.select("channel"), "channel", "left_anti")
    new = new.withColumn("analytics_enabled", F.lit(True))
    return registry.unionByName(new, allowMissingColumns=True)


def enabled_channels(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of channels that aren't switched off; an unknown channel is on."""
    return rows.join(registry.where(~F.col("analytics_enabled")).select("channel"), "channel", "left_anti")


def resolve_params(channels: DataFrame, registry: DataFrame, request: dict[str, float | None], defaults: ChannelParams = ChannelParams()) -> DataFrame:
    """Each channel's parameters: the request's, else the channel's, else the defaults; null means not set, 0 doesn't."""
    names = ("hampel_window", "hampel_kappa", "hampel_min_sigma", "feature_window", "residual_k")
    joined = channels.join(registry.select("channel", *names), "channel", "left")
    chosen = [F.coalesce(F.lit(request.get(n)), F.col(n), F.lit(getattr(defaults, n))).cast("double").alias(n) for n in names]
    return joined.select("channel", *chosen)


def hot_window(rows: DataFrame, length: int, *identity: str) -> DataFrame:
    """The newest ``length`` of each channel, counted from its own last time; of equal times the last arrival, or one
    for each ``identity``."""
    wm = channel_watermark(rows)
    recent = rows.join(wm, "channel").where(F.col("ts") >= F.col("watermark") - length).drop("watermark")
    return dedup_last(recent, "channel", "ts", *identity)


def out_of_order_count(rows: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Of each channel, rows older than the newest that arrived before. ``arrival`` is a whole number; chunks of so
    many arrivals are looked at apart."""
    return marked_late(rows, chunk).groupBy("channel").agg(F.count_if("late").alias("out_of_order"))


def marked_late(rows: DataFrame, chunk: int) -> DataFrame:
    seen = prefix.largest_before(prefix.chunked(rows, F.col("arrival"), chunk), ("channel",), "arrival", "ts", "l_top")
    return seen.withColumn("late", F.col("ts") < F.col("l_top")).drop("l_top", "c_chunk")


def conflate_live(points: DataFrame, window: int) -> DataFrame:
    """Points not older than ``window`` before their channel's last."""
    return points.join(channel_watermark(points), "channel").where(F.col("ts") >= F.col("watermark") - window).drop("watermark")


def profile_source(rows: DataFrame, per_packet: int, chunk: int = 1_000_000) -> DataFrame:
    """One row of statistics of a source."""
    return marked_late(rows, chunk).agg(
        F.count("*").alias("n_rows"), F.count_distinct("channel").alias("channels"), F.min("ts").alias("t_first"), F.max("ts").alias("t_last"),
        F.ceil(F.count("*") / per_packet).alias("packets"), F.count_if("late").alias("out_of_order"),
    )


def scan_registry(registry: DataFrame) -> DataFrame:
    return registry.orderBy("channel")


def scan_models(models: DataFrame, channels: tuple[str, ...] = ()) -> DataFrame:
    """Model versions, the newest of a channel first."""
    found = models.where(F.col("channel").isin(*channels)) if channels else models
    return found.orderBy("channel", F.desc("model_id"))


def active_models(models: DataFrame) -> DataFrame:
    """channel, forecaster, classifier: paths of the active versions."""
    return models.where("active").groupBy("channel").pivot("kind", ["forecaster", "classifier"]).agg(F.max_by("path", "model_id"))


def activate_model(models: DataFrame, model_id: int) -> DataFrame:
    """Makes one version the active one of its channel and kind."""
    target = models.where(F.col("model_id") == model_id).select(F.col("channel").alias("t_channel"), F.col("kind").alias("t_kind"))
    same = (F.col("channel") == F.col("t_channel")) & (F.col("kind") == F.col("t_kind"))
    joined = models.join(F.broadcast(target), same, "left")  # at most one row
    return joined.withColumn("active", F.when(F.col("t_channel").isNotNull(), F.col("model_id") == model_id).otherwise(F.col("active"))).drop("t_channel", "t_kind")


def register_model(models: DataFrame, model_id: int, channel: str, kind: str, path: str) -> DataFrame:
    row = models.sparkSession.createDataFrame([(model_id, channel, kind, path, True)], models.schema)
    return activate_model(models.unionByName(row), model_id)


def latency_percentiles(samples: DataFrame, newest: int = 10_000) -> DataFrame:
    """Milliseconds over the newest samples of each stage, rounded to 3 digits."""
    kept = newest_per_key(samples, "stage", "seq", newest)
    p = F.percentile("us", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    ms = lambda c: F.rint(c) / 1000  # noqa: E731  whole microseconds
    out = kept.groupBy("stage").agg(F.count("*").alias("n"), p.alias("p"), F.max("us").alias("top"))
    return out.select("stage", "n", ms(F.col("p")[0]).alias("p50"), ms(F.col("p")[1]).alias("p95"), ms(F.col("p")[2]).alias("p99"), ms(F.col("top")).alias("max_ms"))


def newest_per_key(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("k_number", number).where(F.col("k_number") <= n).drop("k_number")


def load_metrics(batches: DataFrame, period: int) -> DataFrame:
    """worker, t, rate (points a second), tau (seconds a point), rho = rate * tau. batches: worker, ts, points, busy_us."""
    sums = batches.groupBy("worker", (F.col("ts") - F.pmod("ts", F.lit(period))).alias("t")).agg(F.sum("points").alias("points"), F.sum("busy_us").alias("busy_us"))
    rate, tau = F.col("points") / (period / 1e6), F.try_divide(F.col("busy_us") / 1e6, F.col("points"))
    return sums.select("worker", "t", F.round(rate, 6).alias("rate"), F.round(tau, 6).alias("tau"), F.round(rate * tau, 6).alias("rho"))
