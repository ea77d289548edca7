"""Forecasters and classifiers of channels: gradient-boosted trees on window features.

A model belongs to one channel, and a model of a hundred trees of depth six would ask Spark ML for six hundred jobs a
channel, one after another. Models are therefore fitted side by side: a channel of up to ``whole`` rows in a task, the
larger ones over shards of rows, all of them in the same jobs (see boosting). Either way a channel's trees see all of its
training rows. Models are rows of a table (see models.TABLE) from the task that fits them to the one that uses them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..params import ChannelParams
from ..storage import with_columns, written
from .boosting import BINS, LEAF, Boosting, Trees, boosted, boosted_shards  # noqa: F401
from .filters import INPUTS, chronological_split, increment_target, robust_sigma
from .models import CLASSIFIER, FORECASTER, TABLE, ChannelModel, in_groups

WHOLE = 5_000_000  # rows of a channel that one task fits, at about 100 bytes a row; larger channels are fitted over shards


def standardize_features(rows: DataFrame, fit_on: DataFrame) -> DataFrame:
    """Features less their mean, by their population deviation (0 counts as 1), as learned on fit_on."""
    stats = fit_on.groupBy("channel").agg(*(F.avg(c).alias("m_" + c) for c in INPUTS), *(F.stddev_pop(c).alias("s_" + c) for c in INPUTS))
    joined = rows.join(stats, "channel")
    scaled = [((F.col(c) - F.col("m_" + c)) / F.when(F.col("s_" + c) > 0, F.col("s_" + c)).otherwise(1.0)).alias("z_" + c) for c in INPUTS]
    return joined.select(*rows.columns, *scaled)


@dataclass
class Forecast:
    """The filtered value and the change that a model of standardised inputs expects."""

    mean: np.ndarray
    spread: np.ndarray
    change: Trees
    scale: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x[:, 0] + self.scale * self.change((x - self.mean) / self.spread)


@dataclass
class Probability:
    mean: np.ndarray
    spread: np.ndarray
    odds: Trees

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds((x - self.mean) / self.spread)))


def _standard(x: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of a column (0 counts as 1)."""
    return float(x.mean()), float(x.std()) or 1.0


TABLE_COLUMNS = [c.split()[0] for c in TABLE.split(", ")]


def _fitted(rows: DataFrame, target: str, how: Boosting, scaled: bool, make: Callable[..., Any], whole: int, kind: str, version: str, gamma: Column | None = None) -> DataFrame:
    """A model table with make(mean, spread, scale, trees) of each channel that has rows, fitted on all of them."""
    rows = rows.select("channel", "ts", *INPUTS, F.col(target).cast("double").alias("f_y"))
    counts = written(rows.groupBy("channel").agg(F.count("*").alias("f_n")))

    def fits(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.empty((len(INPUTS) + 1, 0)), 0
        for pdf in batches:
            if not n:
                held = np.empty((len(held), int(pdf.f_n.iloc[0])))
            held[:, n : n + len(pdf)] = pdf[[*INPUTS, "f_y"]].to_numpy(float).T
            n += len(pdf)
        x, y = held[:-1], held[-1]
        mean, spread = (np.array(a) for a in zip(*map(_standard, x), strict=True))
        scale = (float(y.std()) or 1.0) if scaled else 1.0
        x -= mean[:, None]
        x /= spread[:, None]
        y /= scale
        model = make(mean, spread, scale, boosted(x.T, y, how.trees, how.depth, how.rate, how.logistic))
        yield pd.DataFrame({"channel": key, "bytes": [cloudpickle.dumps(model)]})

    # by ranges, as those weigh rows: hashes would put channels into one task while others are idle
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = rows.join(counts.where(F.col("f_n") <= whole), "channel").repartitionByRange(tasks, "channel").sortWithinPartitions("channel", "ts")
    found = few.groupBy("channel").applyInPandas(fits, "channel string, bytes binary")
    large = counts.where(F.col("f_n") > whole).select("channel")
    if not large.isEmpty():
        dealt = boosted_shards(rows.join(large, "channel", "left_semi"), "channel", "ts", INPUTS, "f_y", how, scaled)
        found = found.unionByName(rows.sparkSession.createDataFrame([(c, bytearray(cloudpickle.dumps(make(*m)))) for c, *m in dealt], found.schema))
    none = F.lit(None).cast("double")
    return written(found.select("channel", F.lit(kind).alias("kind"), F.lit(version).alias("version"), none.alias("sigma"), (none if gamma is None else gamma).alias("gamma"), "bytes"))


def train_forecasters(
    diagnosed: DataFrame, p: ChannelParams = ChannelParams(), trees: int = 100, depth: int = 6, rate: float = 0.1, whole: int = WHOLE, version: str = "boosted"
) -> tuple[DataFrame, DataFrame]:
    """A model table with a forecaster of each channel that has rows to train on, and their metrics.

    Fitted on the first 60 % of a channel's rows, spread of residuals (raw next values less forecasts) on the next
    20 %, errors (filtered next values) on the rest. Metrics: channel, n_train, n_val, n_test, sigma, mae, mae_naive,
    gain."""
    gap = max(p.hampel_window, p.feature_window)
    rows = written(chronological_split(written(increment_target(diagnosed, p)), gap, p.chunk))
    make = lambda mean, spread, scale, change: Forecast(mean, spread, change, scale)
    models = _fitted(rows.where(F.col("part") == "train"), "y", Boosting(trees, depth, rate), True, make, whole, FORECASTER, version)
    return with_sigma(rows, models)


def with_sigma(rows: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models with the spread of their residuals, and their metrics, from split rows with y and next_val."""
    predicted = written(predict_forecasters(rows, models))
    residual = predicted.where(F.col("part") == "val").withColumn("r", F.col("next_val") - F.col("pred_next"))
    error = lambda c: F.avg(F.when(F.col("part") == "test", F.abs(F.col("val_f") + F.col("y") - F.col(c))))
    counts = predicted.groupBy("channel").agg(*(F.count_if(F.col("part") == c).alias("n_" + c) for c in ("train", "val", "test")), error("pred_next").alias("mae"), error("val_f").alias("mae_naive"))
    metrics = counts.join(robust_sigma(residual, "r", "channel"), "channel", "left").withColumn("gain", 1 - F.try_divide(F.col("mae"), F.col("mae_naive")))
    metrics = written(metrics.select("channel", "n_train", "n_val", "n_test", "sigma", "mae", "mae_naive", "gain"))
    known = models.drop("sigma").join(metrics.select("channel", "sigma"), "channel", "left")
    return written(known.select(*TABLE_COLUMNS)), metrics


def _applied(rows: DataFrame, models: DataFrame, columns: dict[str, str], f, chunk: int, keep: bool) -> DataFrame:
    """rows with the columns of f(model, inputs); null without features and, if rows without a model are kept, there."""

    def applied(key, model: ChannelModel | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if model is None and not keep:
                return
            found = {c: np.full(len(pdf), np.nan) for c in columns}
            ready = np.flatnonzero(pdf["mean"].notna())
            if model is not None and len(ready):
                for c, x in f(model, pdf.iloc[ready][list(INPUTS)].to_numpy(float)).items():
                    found[c][ready] = x
            yield pdf.drop(columns="c_chunk").assign(**{c: pd.array(x, "Float64") for c, x in found.items()})

    return in_groups(rows.withColumn("c_chunk", floor_div(F.col("ts"), chunk)), models, ("channel", "c_chunk"), applied, with_columns(rows.schema, columns))


def predict_forecasters(rows: DataFrame, models: DataFrame, chunk: int = ChannelParams().chunk) -> DataFrame:
    """pred_next of rows that have features and a model."""
    return _applied(rows.where(F.col("mean").isNotNull()), models, {"pred_next": "double"}, lambda m, x: {"pred_next": m.forecast(x)}, chunk, keep=False)


def train_classifiers(rows: DataFrame, label: str, gamma: float, trees: int = 20, depth: int = 4, rate: float = 0.1, whole: int = WHOLE, version: str = "boosted") -> DataFrame:
    """A model table with a classifier of each channel, learned from rows with features and a label of 0 or 1."""
    make = lambda mean, spread, scale, odds: Probability(mean, spread, odds)
    fine = rows.where(F.col("mean").isNotNull() & F.col(label).isin(0, 1))
    return _fitted(fine, label, Boosting(trees, depth, rate, logistic=True), False, make, whole, CLASSIFIER, version, F.lit(gamma))


def predict_classifiers(rows: DataFrame, models: DataFrame, chunk: int = ChannelParams().chunk) -> DataFrame:
    """prob, anomaly (prob > gamma, or residual_flag), and the score: the larger of both ratios. rows: features, resid,
    thr, residual_flag."""
    judge = lambda m, x: {"prob": m.classify(x), "m_limit": m.gamma} if m.classify else {}
    out = _applied(rows, models, {"prob": "double", "m_limit": "double"}, judge, chunk, keep=True)
    likely = F.coalesce(F.col("prob") > F.col("m_limit"), F.lit(False))
    flag = F.coalesce(F.col("residual_flag"), F.lit(False))
    ratio = F.when(flag, F.coalesce(F.try_divide(F.col("resid"), F.col("thr")), F.lit(1.0)))
    share = F.when(likely, F.coalesce(F.try_divide(F.col("prob"), F.col("m_limit")), F.lit(1.0)))
    return out.withColumns({"anomaly": flag | likely, "score": F.greatest(ratio, share)}).drop("m_limit")
