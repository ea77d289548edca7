"""Models of channels as stored rows.

A model table has a row for each channel, kind and version. It may have as many channels as the data: models are never
collected, put into a plan or sent to all workers. A job that applies them puts each channel's row in front of the
channel's data, once for each chunk that a task walks, so a task holds one model at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORECASTER, CLASSIFIER = "forecaster", "classifier"
#: sigma: the spread of a forecaster's residuals (null: learned online); gamma: the limit of a classifier's probability;
#: bytes: the pickled function of rows of inputs (null: none).
TABLE = "channel string, kind string, version string, sigma double, gamma double, bytes binary"


@dataclass(frozen=True)
class ChannelModel:
    """What was learned for a channel. Both functions take rows of INPUTS: ``forecast`` gives next values (the filtered
    value itself, if there is none), with residuals spread by ``sigma`` (learned online, if null); ``classify`` gives
    probabilities of an anomaly, which count above ``gamma``."""

    forecast: Callable[[np.ndarray], np.ndarray] | None = None
    sigma: float | None = None
    classify: Callable[[np.ndarray], np.ndarray] | None = None
    gamma: float = 0.5
    version: str = "naive"


NAIVE = ChannelModel()


def model_rows(spark: SparkSession, models: dict[str, ChannelModel]) -> DataFrame:
    """A model table of a few models made by hand."""
    rows = []
    for channel, m in models.items():
        rows.append((channel, FORECASTER, m.version, m.sigma, None, m.forecast and cloudpickle.dumps(m.forecast)))
        if m.classify is not None:
            rows.append((channel, CLASSIFIER, m.version, None, m.gamma, cloudpickle.dumps(m.classify)))
    return spark.createDataFrame(rows, TABLE)


def active_only(models: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of a model table whose version is the path of an active version in the registry (channel, kind, path,
    active, model_id); of several active ones the newest."""
    newest = registry.where("active").groupBy("channel", "kind").agg(F.max_by("path", "model_id").alias("version"))
    return models.join(newest, ["channel", "kind", "version"], "left_semi")


def by_channel(models: DataFrame) -> DataFrame:
    """A row a channel with its forecaster and classifier: of several versions, the one that sorts last."""
    of = lambda kind, *columns: F.max_by(F.struct(*columns, "version"), F.when(F.col("kind") == kind, F.col("version")))
    both = models.groupBy("channel").agg(of(FORECASTER, "bytes", "sigma").alias("f"), of(CLASSIFIER, "bytes", "gamma").alias("c"))
    return both.select(
        "channel", F.col("f.bytes").alias("m_forecast"), F.col("f.sigma").alias("m_sigma"), F.col("c.bytes").alias("m_classify"), F.col("c.gamma").alias("m_gamma"), F.coalesce("f.version", "c.version").alias("m_version"),
    )


M_COLUMNS = ("m_forecast", "m_sigma", "m_classify", "m_gamma", "m_version")


Work = Callable[[tuple, ChannelModel | None, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def in_groups(rows: DataFrame, models: DataFrame | None, keys: tuple[str, ...], work: Work, schema: Any, functions: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """work(key, the channel's model or None, batches in order of ts) for each group of rows; keys begin with channel.

    Without ``functions`` a model comes with its numbers only. ``groups`` names the groups where that is cheaper than
    from the rows."""

    def bare(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return work(key, None, batches)

    if models is None:
        ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "ts")
        return ordered.groupBy(*keys).applyInPandas(bare, schema)

    def headed(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches)
        model = None
        if first["m_head"].iloc[0]:
            head, first = first.iloc[0], first.iloc[1:]
            made = lambda c: None if head[c] is None else cloudpickle.loads(head[c])
            number = lambda c, other: other if pd.isna(head[c]) else float(head[c])
            model = ChannelModel(made("m_forecast"), number("m_sigma", None), made("m_classify"), number("m_gamma", np.inf), head["m_version"])

        def rest() -> Iterator[pd.DataFrame]:
            for pdf in chain([first] if len(first) else [], batches):
                yield pdf.drop(columns=["m_head", *M_COLUMNS])

        yield from work(key, model, rest())

    own = by_channel(models)
    if not functions:
        own = own.withColumns({c: F.lit(None).cast("binary") for c in ("m_forecast", "m_classify")})
    heads = (rows if groups is None else groups).select(*keys).distinct().join(own, "channel").withColumn("m_head", F.lit(True))
    both = rows.withColumn("m_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    ordered = both.repartition(*keys).sortWithinPartitions(*keys, F.desc("m_head"), "ts")
    return ordered.groupBy(*keys).applyInPandas(headed, schema)
