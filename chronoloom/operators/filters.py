"""Row-frame analytics of a channel: outlier filter, window features, forecast, splits.

A channel may hold a large part of all rows, so frames aren't taken over whole channels. Rows are cut into chunks of
time, and each chunk also gets the rows before it that its first frames reach back to. A chunk's rows come sorted and
are handled batch by batch, with the last rows of a batch kept for the next, so a task needs no more memory than a
batch, whatever a chunk holds. The result is exact for any spacing of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..params import ChannelParams
from ..storage import with_columns
from . import prefix
from .models import NAIVE, ChannelModel, in_groups

CHANNEL = ("channel",)


def with_halo(rows: DataFrame, reach: int, chunk: int) -> DataFrame:
    """rows (channel, ts, ...) with c_chunk and c_halo: each chunk of ``chunk`` time also has the ``reach`` rows before
    it, as copies. Only the last rows of chunks are looked at twice."""
    here = rows.withColumn("c_chunk", floor_div(F.col("ts"), chunk))
    row = F.struct("ts", *(c for c in rows.columns if c not in ("channel", "ts")))
    back = F.row_number().over(Window.partitionBy("channel", "c_chunk").orderBy(F.desc("ts")))
    tails = here.withColumn("c_back", back).where(F.col("c_back") <= reach).groupBy("channel", "c_chunk").agg(F.sort_array(F.collect_list(row)).alias("c_tail"))
    before = Window.partitionBy("channel").orderBy("c_chunk").rowsBetween(-reach, -1)
    halo = tails.select("channel", "c_chunk", F.flatten(F.collect_list("c_tail").over(before)).alias("c_rows"))
    last = F.slice("c_rows", F.greatest(F.size("c_rows") - reach + 1, F.lit(1)), reach)
    copies = halo.select("channel", "c_chunk", F.explode(last).alias("c_r")).select("channel", "c_r.*", "c_chunk", F.lit(True).alias("c_halo"))
    return here.withColumn("c_halo", F.lit(False)).unionByName(copies)


def hampel(x: np.ndarray, p: ChannelParams) -> dict[str, np.ndarray]:
    """Filter of the values of a channel in order. Before a window is full there is a median, but no sigma."""
    w, n = p.hampel_window, len(x)
    median, sigma = np.full(n, np.nan), np.full(n, np.nan)
    for i in range(min(w - 1, n)):
        median[i] = np.median(x[: i + 1])
    if n >= w:
        view = sliding_window_view(x, w)
        median[w - 1 :] = np.median(view, axis=1)
        sigma[w - 1 :] = 1.4826 * np.median(np.abs(view - median[w - 1 :, None]), axis=1)
    limit = np.maximum(sigma, p.hampel_min_sigma)
    hit = (limit > 0) & (np.abs(x - median) > p.hampel_kappa * limit)
    return {"median": median, "sigma": sigma, "substituted": hit, "val_f": np.where(hit, median, x)}


def features(ts: np.ndarray, v: np.ndarray, p: ChannelParams) -> dict[str, np.ndarray]:
    """Mean, deviation, extremes, root mean square and slope (a second) of the last values; null until there are enough."""
    w, n = p.feature_window, len(v)
    out = {c: np.full(n, np.nan) for c in FEATURES}
    if n >= w:
        x, t = sliding_window_view(v, w), sliding_window_view(ts, w)
        mean = x.mean(axis=1)
        off = (t - t[:, :1]) / 1e6
        off = off - off.mean(axis=1, keepdims=True)
        spread = (off * off).sum(axis=1)
        rise = (off * (x - mean[:, None])).sum(axis=1)
        slope = np.where(spread > 1e-12, rise / np.where(spread > 1e-12, spread, 1), 0.0)
        for c, a in zip(FEATURES, (mean, x.std(axis=1), x.min(axis=1), x.max(axis=1), np.sqrt((x * x).mean(axis=1)), slope), strict=True):
            out[c][w - 1 :] = a
    return out


FEATURES = ("mean", "std", "lo", "hi", "rms", "slope")
INPUTS = ("val_f", *FEATURES)


def diagnosis(ts: np.ndarray, x: np.ndarray, p: ChannelParams, model: ChannelModel = NAIVE) -> dict[str, np.ndarray]:
    """Filter, features, the forecast made at the row before (once that row had features), its residual, and the
    classifier's probability."""
    out = hampel(x, p)
    out |= features(ts, out["val_f"], p)
    ready = np.flatnonzero(~np.isnan(out["mean"]))
    rows = np.stack([out[c][ready] for c in INPUTS], axis=1)
    ahead, prob, pred = np.full(len(x), np.nan), np.full(len(x), np.nan), np.full(len(x), np.nan)
    if len(ready):
        ahead[ready] = rows[:, 0] if model.forecast is None else model.forecast(rows)
        if model.classify is not None:
            prob[ready] = model.classify(rows)
    pred[1:] = ahead[:-1]
    return out | {"pred": pred, "resid": np.abs(x - pred), "prob": prob}


def _framed(rows: DataFrame, reach: int, p: ChannelParams, value: str, work, columns: dict[str, str], models: DataFrame | None = None) -> DataFrame:
    """rows with the columns that work(model, ts, values) gives; ``reach`` rows before a row decide about it."""

    def frames(key: tuple[Any, ...], model: ChannelModel | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ts, x = np.empty(0, np.int64), np.empty(0)
        for pdf in batches:
            ts, x = np.append(ts, pdf["ts"].to_numpy(np.int64)), np.append(x, pdf[value].to_numpy(float))
            mine = ~pdf["c_halo"].to_numpy(bool)
            found = {c: a[len(x) - len(pdf) :][mine] for c, a in work(model or NAIVE, ts, x).items()}
            out = pdf[mine].drop(columns=["c_chunk", "c_halo"])
            yield out.assign(**{c: found[c] if t == "boolean" else pd.array(found[c], "Float64") for c, t in columns.items()})
            ts, x = ts[len(ts) - reach :] if len(ts) > reach else ts, x[len(x) - reach :] if len(x) > reach else x

    groups = rows.select("channel", floor_div(F.col("ts"), p.chunk).alias("c_chunk"))
    return in_groups(with_halo(rows, reach, p.chunk), models, ("channel", "c_chunk"), frames, with_columns(rows.schema, columns), groups=groups)


HAMPEL_COLUMNS = {"median": "double", "sigma": "double", "substituted": "boolean", "val_f": "double"}
FEATURE_COLUMNS = dict.fromkeys(FEATURES, "double")


def hampel_filter(valid: DataFrame, p: ChannelParams = ChannelParams()) -> DataFrame:
    """Causal Hampel filter over the last valid raw values of each channel."""
    return _framed(valid, p.hampel_window - 1, p, "val", lambda m, ts, x: hampel(x, p), HAMPEL_COLUMNS)


def window_features(filtered: DataFrame, p: ChannelParams = ChannelParams()) -> DataFrame:
    return _framed(filtered, p.feature_window - 1, p, "val_f", lambda m, ts, x: features(ts, x, p), FEATURE_COLUMNS)


def diagnosed(valid: DataFrame, p: ChannelParams = ChannelParams(), models: DataFrame | None = None) -> DataFrame:
    """Filter, features, forecast and probability of valid rows in one pass: one halo serves them all. ``models`` is a
    model table (see models.TABLE) with one version in use of each channel and kind."""
    columns = HAMPEL_COLUMNS | FEATURE_COLUMNS | {"pred": "double", "resid": "double", "prob": "double"}
    reach = p.hampel_window - 1 + p.feature_window
    return _framed(valid, reach, p, "val", lambda m, ts, x: diagnosis(ts, x, p, m), columns, models)


def residual_fixed_sigma(rows: DataFrame, sigma: float, k: float) -> DataFrame:
    """thr and anomaly for a residual spread known from a model."""
    return rows.withColumn("thr", F.lit(k * sigma)).withColumn("anomaly", F.coalesce(F.lit(sigma > 0) & (F.col("resid") > k * sigma), F.lit(False)))


def increment_target(rows: DataFrame, p: ChannelParams = ChannelParams()) -> DataFrame:
    """y: the next filtered value minus this one, and next_val, the next raw value, for rows that have features and a
    next row."""
    out = prefix.chunked(rows.withColumn("n_next", F.struct("val_f", "val")), F.col("ts"), p.chunk)
    out = prefix.following(out, CHANNEL, "ts", "n_next", "n_next")
    out = out.withColumn("y", F.col("n_next.val_f") - F.col("val_f")).withColumn("next_val", F.col("n_next.val"))
    return out.where(F.col("y").isNotNull() & F.col("mean").isNotNull()).drop("c_chunk", "n_next")


def chronological_split(rows: DataFrame, gap: int, chunk: int = ChannelParams().chunk) -> DataFrame:
    """part: train (60 %), val (20 %) or test by time, null for the ``gap`` rows that keep two parts apart."""
    counts = rows.groupBy("channel").agg(F.count("*").alias("s_n"))
    i, n_train, n_val = F.col("s_i"), F.floor(F.col("s_n") * 0.6), F.floor(F.col("s_n") * 0.2)
    part = F.when(i < n_train, "train").when((i >= n_train + gap) & (i < n_train + n_val), "val").when(i >= n_train + n_val + gap, "test")
    numbered = prefix.number(prefix.chunked(rows, F.col("ts"), chunk), CHANNEL, "ts", "s_i")
    return numbered.join(counts, "channel").withColumn("part", part).drop("s_i", "s_n", "c_chunk")


def robust_sigma(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """1.4826 * median(|r - median r|) of each key."""
    center = rows.groupBy(*keys).agg(F.median(value).alias("r_center"))
    spread = rows.join(center, list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("r_center"))).alias("r_mad"))
    return spread.select(*keys, (1.4826 * F.col("r_mad")).alias("sigma"))
