"""Models see every row of their channels, in a task or over shards."""

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chronoloom.operators import boosting as B
from chronoloom.operators import ml as ML
from chronoloom.params import ChannelParams
from chronoloom.storage import written

MINUTE = 60_000_000


def frames(spark, n, channels):
    """Rows as the channel pipeline gives them: a column of val_f and six features, the channels' values apart."""
    made = spark.range(n * channels).select(F.concat(F.lit("c"), F.col("id") % channels).alias("channel"), (F.floor(F.col("id") / channels) * MINUTE).alias("ts"), "id")
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 500.0 - 1 + F.col("id") % channels
    names = ("val_f", *ML.INPUTS[1:])
    rows = made.select("channel", "ts", *(noise(k).alias(c) for k, c in enumerate(names)))
    return rows.withColumns({"val": F.col("val_f"), "label": (F.col("std") + 0.3 * F.col("slope") > 0.2).cast("double")})


def loaded(models):
    return {r.channel: cloudpickle.loads(bytes(r.bytes)) for r in models.collect()}


@pytest.mark.parametrize("whole", [ML.WHOLE, 100])
def test_models_come_from_all_rows(spark, whole):
    n = 200_000
    rows = written(frames(spark, n, 1))
    judge = loaded(ML.train_classifiers(rows, "label", 0.5, trees=1, depth=1, whole=whole))["c0"]
    x = np.array(rows.orderBy("ts").select(*ML.INPUTS).toArrow().to_pandas())
    assert np.abs(judge.mean - x.mean(axis=0)).max() < 1e-12 and np.abs(judge.spread - x.std(axis=0)).max() < 1e-12
    models, metrics = ML.train_forecasters(rows, ChannelParams(), trees=1, depth=1, whole=whole)
    first = x[: metrics.first().n_train]
    assert len(first) == int((n - 1) * 0.6)
    assert np.abs(loaded(models)["c0"].mean - first.mean(axis=0)).max() < 1e-12


def test_shards_give_the_same_trees(spark, monkeypatch):
    """Some channels over shards, others in a task: limits, trees and predictions as if all were in tasks."""
    monkeypatch.setattr(B, "SHARD", 150)
    monkeypatch.setattr(B, "CUT", 3)
    p = ChannelParams(chunk=200 * MINUTE)
    rows = frames(spark, 700, 3)
    rows = written(rows.where("channel <> 'c2' or ts < 18000000000"))  # 419 training rows, and 179
    for depth in (1, 3):
        (one, own), (dealt, other) = (ML.train_forecasters(rows, p, trees=4, depth=depth, whole=w) for w in (ML.WHOLE, 200))
        a, b = loaded(one), loaded(dealt)
        assert set(a) == set(b) == {"c0", "c1", "c2"}
        for c in a:
            assert np.abs(a[c].mean - b[c].mean).max() < 1e-12 and (a[c].change.feature == b[c].change.feature).all()
            assert (np.isinf(a[c].change.limit) == np.isinf(b[c].change.limit)).all() and np.isfinite(a[c].change.limit).any()
            assert np.nanmax(np.abs(np.where(np.isinf(a[c].change.limit), 0, a[c].change.limit) - np.where(np.isinf(b[c].change.limit), 0, b[c].change.limit))) < 1e-9
            assert np.abs(a[c].change.leaf - b[c].change.leaf).max() < 1e-9
        for r, s in zip(own.orderBy("channel").collect(), other.orderBy("channel").collect(), strict=True):
            assert r[:4] == s[:4] and np.abs(np.array(r[4:]) - np.array(s[4:])).max() < 1e-9
    judges = [loaded(ML.train_classifiers(rows, "label", 0.5, trees=3, depth=2, whole=w)) for w in (ML.WHOLE, 400)]
    x = np.array(rows.select(*ML.INPUTS).toArrow().to_pandas())
    for c in judges[0]:
        assert all(np.abs(judges[0][c](x) - j[c](x)).max() < 1e-9 for j in judges[1:])


def test_quantiles_of_shards_are_exact(spark):
    rng = np.random.default_rng(5)
    parts = [rng.normal(size=(n, 3)) * [1, 1e-300, 1e9] for n in (1, 40, 333)]
    parts[1][:, 2] = np.where(np.arange(40) % 2, 0.0, -0.0)
    parts[2][:200, 1] = -3.5
    alone = rng.integers(-2, 2, (5, 3)).astype(float)
    shards = spark.sparkContext.parallelize([(0, p) for p in parts] + [(1, alone)], 3)
    for got, x in zip(B.quantiles(shards, [374, 5], 3), (np.concatenate(parts), alone), strict=True):
        assert (got == np.quantile(x, B.FRACTIONS, axis=0).T).all()
