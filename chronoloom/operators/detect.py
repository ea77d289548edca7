"""Residual anomalies with an adaptive spread, and episodes of flagged points."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import ChannelParams
from ..storage import with_columns
from . import prefix
from .filters import diagnosed
from .models import NAIVE, ChannelModel, in_groups


class Spread:
    """The spread of residuals, learned online: that of a normal residual with the running mean of absolute ones. The
    first hundred count alike; from then on each has a weight of 0.01."""

    SIGMA = math.sqrt(math.pi / 2)  # of a normal residual, by its mean absolute value
    WEIGHT = 0.01
    BLOCK = 8192
    _GROWTH = (1 - WEIGHT) ** -np.arange(1.0, BLOCK + 1)
    _DECAY = 1 / _GROWTH

    def __init__(self, warm_up: int, seen: int = 0, mean: float = 0.0):
        self.warm_up, self.seen, self.mean = warm_up, seen, mean

    def sigma(self) -> float:
        """Not a number while warming up."""
        return self.SIGMA * self.mean if self.seen >= self.warm_up else math.nan

    def learn(self, residual: float) -> None:
        self.seen += 1
        self.mean += max(self.WEIGHT, 1 / self.seen) * (residual - self.mean)

    def judge(self, residuals: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
        """Threshold and flag of each residual; one that is flagged, or isn't a number, teaches nothing.

        Means of a block are made at once as if none of it were flagged, and hold up to the first that is. Residuals that
        are within rounding of their threshold are judged one by one."""
        limits = np.full(len(residuals), np.nan)
        known = np.flatnonzero(~np.isnan(residuals))
        r, out = residuals[known], np.full(len(known), np.nan)
        at, size = 0, self.BLOCK
        while at < len(r):
            if self.seen * self.WEIGHT < 1:
                at = self._one(r, out, at, k)
                continue
            block = r[at : at + size]
            means = np.cumsum(block * self._GROWTH[: len(block)])
            means *= self.WEIGHT
            means += self.mean
            means *= self._DECAY[: len(block)]
            limit = np.append(self.mean, means[:-1])
            limit *= k * self.SIGMA
            if self.seen < self.warm_up:
                limit[: self.warm_up - self.seen] = np.nan
            hit = block > limit * (1 - 1e-9)  # flagged, or nearly
            n = int(hit.argmax())
            n = n if hit[n] else len(block)
            out[at : at + n] = limit[:n]
            if n:
                self.mean, self.seen = float(means[n - 1]), self.seen + n
            at += n
            if n == len(block):
                size = min(self.BLOCK, 4 * size)
                continue
            size = min(self.BLOCK, max(64, 2 * n))
            top = limit[n] * (1 + 1e-9)
            if not block[n] > top > 0:
                at = self._one(r, out, at, k)
                continue
            # the threshold stays as it is over all that are flagged in a row
            run = 1
            while at + run < len(r) and r[at + run] > top:
                still = r[at + run : at + 2 * run + 16] > top
                run += len(still) if still.all() else int(still.argmin())
            out[at : at + run] = limit[n]
            at += run
        limits[known] = out
        return limits, (limits > 0) & (residuals > limits)

    def _one(self, r: np.ndarray, out: np.ndarray, at: int, k: float) -> int:
        out[at] = k * self.sigma()
        if not r[at] > out[at] > 0:
            self.learn(float(r[at]))
        return at + 1


def judged(found: dict[str, np.ndarray] | pd.DataFrame, spread: Spread, p: ChannelParams, model: ChannelModel) -> dict[str, np.ndarray]:
    """thr, anomaly and prob_ratio (the probability by its limit, where it counts) from resid and prob."""
    resid, prob = (np.asarray(found[c], dtype=float) for c in ("resid", "prob"))
    if model.sigma is None:
        thr, flag = spread.judge(resid, p.residual_k)
    else:
        thr = np.where(np.isnan(resid), np.nan, p.residual_k * model.sigma)
        flag = (thr > 0) & (resid > thr)
    likely = prob > model.gamma
    ratio = np.where(likely, prob / model.gamma if model.gamma > 0 else 1.0, np.nan)
    return {"thr": thr, "anomaly": flag | likely, "prob_ratio": ratio}


def adaptive_residual(rows: DataFrame, p: ChannelParams = ChannelParams(), models: DataFrame | None = None) -> DataFrame:
    """Adds thr, anomaly and prob_ratio to rows with resid and prob. A spread that is learned online goes on from row to
    row of a channel: a recurrence, which keeps one task busy for each channel. The task walks batch by batch, so it
    needs no more memory than a batch."""

    def steps(key: tuple[Any, ...], model: ChannelModel | None, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spread = Spread(p.warm_up)
        for pdf in frames:
            found = judged({c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in ("resid", "prob")}, spread, p, model or NAIVE)
            yield pdf.assign(**{c: a if a.dtype == bool else pd.array(a, "Float64") for c, a in found.items()})

    return in_groups(rows, models, ("channel",), steps, with_columns(rows.schema, {"thr": "double", "anomaly": "boolean", "prob_ratio": "double"}), functions=False)


PIPELINE = ("channel", "ts", "val", "val_f", "median", "substituted", "pred", "resid", "prob")


def channel_pipeline(valid: DataFrame, p: ChannelParams = ChannelParams(), models: DataFrame | None = None) -> DataFrame:
    """Filter, features, forecast, residual and classifier of all valid rows (channel, ts, val)."""
    return adaptive_residual(diagnosed(valid.select("channel", "ts", "val"), p, models).select(*PIPELINE), p, models)


def flagged_points(diagnosis: DataFrame) -> DataFrame:
    return diagnosis.where(F.col("substituted") | F.col("anomaly"))


def scored_flags(diagnosis: DataFrame) -> DataFrame:
    """channel, kind, ts, val, score: an anomaly's residual by its threshold (1 without one) or, if larger, its
    probability by its limit; an outlier's distance from the median."""
    ratio = F.coalesce(F.when(F.col("thr") != 0, F.col("resid") / F.nullif(F.col("thr"), F.lit(0.0))), F.lit(1.0))
    anomaly = diagnosis.where("anomaly").select("channel", F.lit("anomaly").alias("kind"), "ts", "val", F.greatest(ratio, "prob_ratio").alias("score"))
    outlier = diagnosis.where("substituted").select("channel", F.lit("outlier").alias("kind"), "ts", "val", F.abs(F.col("val") - F.col("median")).alias("score"))
    return anomaly.unionByName(outlier)


def flag_islands(flags: DataFrame, gap: int, chunk: int = ChannelParams().chunk) -> DataFrame:
    """Adds island, a number for each run of flags with gaps of at most ``gap``."""
    keys = ("channel", "kind")
    rows = prefix.preceding(prefix.chunked(flags.withColumn("i_ts", F.col("ts")), F.col("ts"), chunk), keys, "ts", "i_ts", "i_last")
    rows = rows.withColumn("i_new", F.when(F.col("ts") - F.col("i_last.i_ts") <= gap, 0).otherwise(1))
    return prefix.sum_so_far(rows, keys, "ts", "i_new", "island").select(*flags.columns, "island")


def build_episodes(flags: DataFrame, gap: int) -> DataFrame:
    """channel, kind, ts_start, ts_end, n_points and the first highest-scored point, of flags (channel, kind, ts, val, score)."""
    session = F.session_window(F.timestamp_micros("ts"), f"{gap} microseconds")
    peak = F.max(F.struct("score", (-F.col("ts")).alias("t"), "val"))
    grouped = flags.groupBy("channel", "kind", session.alias("s")).agg(F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.count("*").alias("n_points"), peak.alias("p"))
    return grouped.select("channel", "kind", "ts_start", "ts_end", "n_points", (-F.col("p.t")).alias("peak_ts"), F.col("p.val").alias("peak_value"), F.col("p.score").alias("score"))


def analysis_report(diagnosis: DataFrame, episodes: DataFrame, metrics: DataFrame | None = None, overall: DataFrame | None = None) -> DataFrame:
    """Counts of points, substitutions, anomalies and episodes of each channel and, in a row with a null channel, of
    all; with ``metrics`` (a row a channel) and ``overall`` (one row), what evaluation says of them."""
    tallies = ("n", "substituted", "anomalies", "anomaly_episodes", "outlier_episodes")
    points = diagnosis.groupBy("channel").agg(F.count("*").alias("n"), F.count_if("substituted").alias("substituted"), F.count_if("anomaly").alias("anomalies"))
    kinds = episodes.groupBy("channel").agg(F.count_if(F.col("kind") == "anomaly").alias("anomaly_episodes"), F.count_if(F.col("kind") == "outlier").alias("outlier_episodes"))
    rows = points.join(kinds, "channel", "left").fillna(0, ["anomaly_episodes", "outlier_episodes"])
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tallies))  # one row
    if metrics is None or overall is None:
        return rows.unionByName(total.withColumn("channel", F.lit(None).cast("string")))
    drop = ("episodes",)
    total = total.crossJoin(F.broadcast(overall.drop(*drop))).withColumn("channel", F.lit(None).cast("string"))
    return rows.join(metrics.drop(*drop), "channel", "left").unionByName(total)
