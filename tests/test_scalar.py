"""Literal cases of the column functions."""

from pyspark.sql import functions as F

from chronoloom.functions import scalar as S
from chronoloom.params import Grid


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_time_units(spark):
    scales = [S.unit_scale(F.lit(float(x))) for x in (1735689600, 1735689600_000, 1735689600_000_000, 1735689600 * 10**9)]
    assert list(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(scales)])) == [1e6, 1e3, 1.0, 1e-3]


def test_parse_time(spark):
    row = one(spark, S.parse_time(F.lit("1735689600000000")).alias("a"), S.parse_time(F.lit("2025-01-01T00:00:00Z")).alias("b"), S.parse_time(F.lit("2025-01-01T02:00:00+02:00")).alias("c"), S.parse_time(F.lit("soon")).alias("d"))
    assert list(row) == [1735689600000000] * 3 + [None]


def test_quality_order(spark):
    q = lambda v, nd, otkl: S.quality(F.lit(v).cast("double"), F.lit(nd), F.lit(otkl), F.lit(-10.0), F.lit(10.0))
    row = one(spark, q(None, False, 1).alias("a"), q(1.0, True, 0).alias("b"), q(1.0, False, 2).alias("c"), q(50.0, False, 0).alias("d"), q(10.0, False, 0).alias("e"), q(float("nan"), False, 0).alias("f"))
    assert list(row) == ["bad", "bad", "uncertain", "uncertain", "good", "bad"]


def test_targets_and_levels(spark):
    day, g = 86_400_000_000, Grid()
    row = one(
        spark, S.target_points(F.lit(10_000), 1600, 2.0).alias("a"), S.target_points(F.lit(100), 1600, 2.0).alias("b"), F.round(S.reduction_ratio(F.lit(3486), F.lit(120)), 4).alias("c"),
        S.reduction_ratio(F.lit(0), F.lit(0)).alias("d"), S.grid_delta(F.lit(60_000_000), F.lit(300)).alias("e"), S.select_level(F.lit(0), F.lit(day), F.lit(3200), g, 2.0).alias("f"),
        S.select_level(F.lit(0), F.lit(60_000_000), F.lit(3200), g, 2.0).alias("g"), S.floor_div(F.lit(-1), 10).alias("h"), S.shard_of(F.lit("A001"), 7).alias("i"),
    )
    level = row.f
    assert list(row)[:5] == [3200, 100, 0.9656, 0.0, 200_000]
    assert day / g.width(level) >= 3200 > day / g.width(level + 1) and row.g == 0 and row.h == -1 and row.i == 2820616989 % 7


def test_rebase(spark):
    rows = spark.createDataFrame([(10_000_000,), (20_000_000,)], "ts long")
    assert [r[0] for r in rows.select(S.rebase(F.col("ts"), F.lit(10_000_000), 2.0, 5_000_000)).collect()] == [15_000_000, 20_000_000]
