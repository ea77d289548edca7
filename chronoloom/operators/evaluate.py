"""Episodes against labels: overlaps, precision, recall, delay; and re-analysis of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DAY, ChannelParams
from ..storage import written
from .detect import analysis_report, build_episodes, channel_pipeline, flagged_points, scored_flags


def _days(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / DAY), F.floor(end / DAY)))


def overlaps(labels: DataFrame, episodes: DataFrame, tolerance: int) -> DataFrame:
    """label_id, channel, type, ts_start, e_start, e_end: each label with each anomaly episode that meets it.

    Both are cut into the days they touch, so the join is an equality of channel and day; a pair counts in the first
    day that both touch."""
    a = labels.select("label_id", "channel", "type", "ts_start", "ts_end", _days(F.col("ts_start") - tolerance, F.col("ts_end") + tolerance).alias("o_day"))
    b = episodes.where(F.col("kind") == "anomaly").select("channel", F.col("ts_start").alias("e_start"), F.col("ts_end").alias("e_end"))
    b = b.select("*", _days(F.col("e_start"), F.col("e_end")).alias("o_day"))
    lo, hi = F.col("ts_start") - tolerance, F.col("ts_end") + tolerance
    meet = (F.col("e_start") <= hi) & (F.col("e_end") >= lo)
    first = F.col("o_day") == F.greatest(F.floor(lo / DAY), F.floor(F.col("e_start") / DAY))
    return a.join(b, ["channel", "o_day"]).where(meet & first).drop("o_day", "ts_end")


def label_episode_overlap(labels: DataFrame, episodes: DataFrame, tolerance: int) -> DataFrame:
    """Every label with detected and the delay of its first episode in seconds."""
    hits = overlaps(labels, episodes, tolerance).groupBy("label_id").agg(F.min("e_start").alias("e_first"))
    delay = F.when(F.col("e_first").isNotNull(), F.greatest(F.lit(0), F.col("e_first") - F.col("ts_start")) / 1e6)
    return labels.join(hits, "label_id", "left").select("label_id", "channel", "type", F.col("e_first").isNotNull().alias("detected"), delay.alias("delay_s"))


def episode_true_positive(labels: DataFrame, episodes: DataFrame, tolerance: int) -> DataFrame:
    """Anomaly episodes that meet a label."""
    hits = overlaps(labels, episodes, tolerance).select("channel", F.col("e_start").alias("ts_start")).distinct()
    return episodes.where(F.col("kind") == "anomaly").join(hits, ["channel", "ts_start"], "left_semi")


def detection_metrics(labels: DataFrame, episodes: DataFrame, tolerance: int) -> DataFrame:
    """Of each channel with labels: episodes, labels, precision, recall, f1 and mean delay."""
    found = label_episode_overlap(labels, episodes, tolerance).groupBy("channel").agg(
        F.count("*").alias("labels"), F.count_if("detected").alias("detected"), F.avg("delay_s").alias("mean_delay_s")
    )
    every = episodes.where(F.col("kind") == "anomaly").groupBy("channel").agg(F.count("*").alias("episodes"))
    right = episode_true_positive(labels, episodes, tolerance).groupBy("channel").agg(F.count("*").alias("true_positives"))
    out = found.join(every, "channel", "left").join(right, "channel", "left").fillna(0, ["episodes", "true_positives"])
    return _rates(out)


def overall_metrics(labels: DataFrame, episodes: DataFrame, tolerance: int) -> DataFrame:
    """One row of detection_metrics over all channels with labels; labels and episodes meet within their channel."""
    found = label_episode_overlap(labels, episodes, tolerance).agg(F.count("*").alias("labels"), F.count_if("detected").alias("detected"), F.avg("delay_s").alias("mean_delay_s"))
    own = episodes.join(labels.select("channel").distinct(), "channel", "left_semi")
    every = own.where(F.col("kind") == "anomaly").agg(F.count("*").alias("episodes"))
    right = episode_true_positive(labels, own, tolerance).agg(F.count("*").alias("true_positives"))
    out = found.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(right))  # one row each
    return _rates(out)


def _rates(out: DataFrame) -> DataFrame:
    precision = F.try_divide(F.col("true_positives").cast("double"), F.col("episodes"))
    recall = F.try_divide(F.col("detected").cast("double"), F.col("labels"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    keep = ["channel"] if "channel" in out.columns else []
    return out.select(*keep, "episodes", "labels", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "mean_delay_s")


def recall_by_type(labels: DataFrame, episodes: DataFrame, tolerance: int) -> DataFrame:
    return label_episode_overlap(labels, episodes, tolerance).groupBy("type").agg(F.count_if("detected").alias("detected"), F.count("*").alias("total"))


def forecast_mae(rows: DataFrame) -> DataFrame:
    """mae of pred and of a forecast without change, and the gain. rows: channel, actual, pred, naive."""
    mae = lambda c: F.avg(F.abs(F.col("actual") - F.col(c)))
    out = rows.where(F.col("pred").isNotNull() & F.col("naive").isNotNull()).groupBy("channel").agg(F.count("*").alias("n"), mae("pred").alias("mae"), mae("naive").alias("mae_naive"))
    return out.withColumn("gain", 1 - F.try_divide(F.col("mae"), F.col("mae_naive")))


def reanalyze(
    valid: DataFrame, p: ChannelParams, run: str, labels: DataFrame | None = None, tolerance: int = 0, models: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The pipeline over history under a run id, with new parameters or models: diagnosis (written), episodes, report
    and, with labels, metrics."""
    diagnosis = written(channel_pipeline(valid, p, models).withColumn("run", F.lit(run)))
    episodes = build_episodes(scored_flags(diagnosis), p.episode_gap).withColumn("run", F.lit(run))
    out = {"diagnosis": diagnosis, "episodes": episodes}
    if labels is None:
        return out | {"report": analysis_report(diagnosis, episodes)}
    out["metrics"] = detection_metrics(labels, episodes, tolerance)
    return out | {"report": analysis_report(diagnosis, episodes, out["metrics"], overall_metrics(labels, episodes, tolerance))}


def preview_summary(diagnosis: DataFrame, episodes: DataFrame, first: int = 5_000) -> DataFrame:
    """What a preview shows, told apart by ``part``: a summary row (n, substituted, anomalies, episodes), the ``first``
    flagged points in order of time (channel, ts, val, val_f), and the episodes (channel, kind, ts, ts_end, score)."""
    points = diagnosis.agg(F.count("*").alias("n"), F.count_if("substituted").alias("substituted"), F.count_if("anomaly").alias("anomalies"))
    summary = points.crossJoin(F.broadcast(episodes.agg(F.count("*").alias("episodes"))))  # one row each
    flags = flagged_points(diagnosis).orderBy("ts", "channel").limit(first).select(F.lit("flag").alias("part"), "channel", "ts", "val", "val_f")
    spans = episodes.select(F.lit("episode").alias("part"), "channel", "kind", F.col("ts_start").alias("ts"), "ts_end", "score")
    return summary.withColumn("part", F.lit("summary")).unionByName(flags, allowMissingColumns=True).unionByName(spans, allowMissingColumns=True)
