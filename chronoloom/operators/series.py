"""Chart queries: the resolution of each channel, its points, and the layers drawn over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import reduction_ratio, select_level
from ..params import ChartParams, Grid
from ..storage import written
from .downsample import lttb
from .grid import minmax_points, preselected


def raw_with_substitution(raw: DataFrame, flags: DataFrame) -> DataFrame:
    """Raw points; where the online run replaced a value, quality is 'substituted' and val_f is given."""
    over = flags.where((F.col("run") == "online") & F.col("substituted")).select("channel", "ts", "val_f", F.lit(True).alias("s_hit"))
    out = raw.join(over, ["channel", "ts"], "left")
    return out.withColumn("quality", F.when(F.col("s_hit"), "substituted").otherwise(F.col("quality"))).drop("s_hit")


def _width(grid: Grid) -> Column:
    return F.element_at(F.array(*(F.lit(grid.width(i)) for i in range(grid.levels))), F.col("lvl") + 1)


def route_resolution(archive: DataFrame, levels: DataFrame, watermarks: DataFrame, t_from: int, t_to: int, chart: ChartParams, grid: Grid, hot: int) -> DataFrame:
    """channel, source (hot, raw, agg or empty), level, n, m for each channel with a watermark; and of its values that
    aren't null in the range t0, t1 and n_known.

    Raw rows if the range begins in the hot window or is short for the grid; else the level's buckets, unless they hold
    no more than m points. A channel without rows where it looks for them is empty."""
    m = max(3, math.ceil(chart.per_pixel * chart.width))
    short = 2 * (t_to - t_from) / grid.delta < chart.rho * m
    known = F.col("val").isNotNull()
    inside = archive.where((F.col("ts") >= t_from) & (F.col("ts") < t_to)).groupBy("channel")
    counts = inside.agg(F.count("*").alias("n_raw"), F.count_if(known).alias("n_known"), F.min(F.when(known, F.col("ts"))).alias("t0"), F.max(F.when(known, F.col("ts"))).alias("t1"))
    out = watermarks.withColumn("lvl", select_level(F.lit(t_from), F.lit(t_to), F.lit(m), grid, chart.rho))
    level = [select_level(F.lit(t_from), F.lit(t_to), F.lit(m), grid, chart.rho) == F.col("lvl"), F.col("bucket") + _width(grid) > t_from, F.col("bucket") < t_to]
    sums = levels.where(level[0] & level[1] & level[2]).groupBy("channel").agg(F.sum("cnt").alias("n_agg"))
    out = out.join(counts, "channel", "left").join(sums, "channel", "left").fillna(0, ["n_raw", "n_known", "n_agg"])
    is_hot = F.col("watermark").isNotNull() & (F.lit(t_from) >= F.col("watermark") - hot)
    raw = F.lit(short) | is_hot | (F.col("n_agg") <= m)
    source = F.when(raw & (F.col("n_raw") == 0), "empty").when(is_hot, "hot").when(raw, "raw").otherwise("agg")
    return out.select(
        "channel", source.alias("source"), F.when(~raw, F.col("lvl")).alias("level"),
        F.when(raw, F.col("n_raw")).otherwise(F.col("n_agg")).alias("n"), F.lit(m).cast("long").alias("m"), "t0", "t1", "n_known",
    )


ROUTE_ROWS = 1_000_000  # channels up to which the route is broadcast


def series_query(archive: DataFrame, levels: DataFrame, watermarks: DataFrame, t_from: int, t_to: int, chart: ChartParams, grid: Grid, hot: int) -> DataFrame:
    """channel, ts, val, quality, source, level, n, m, eta: the points of each channel's chart, in one plan for all
    channels; a channel without points has one row with a null ts.

    The route (a row a channel) is written first; then archive and levels are each read once. Raw ranges with no more
    than m rows come as they are, nulls included; longer ones through extremes and LTTB; levels through their extremes,
    without a quality, and LTTB where those are more than m. Only LTTB leaves the JVM, on reduced points."""
    m = max(3, math.ceil(chart.per_pixel * chart.width))
    route = written(route_resolution(archive, levels, watermarks, t_from, t_to, chart, grid, hot))
    route = F.broadcast(route) if route.count() <= ROUTE_ROWS else route
    is_raw = F.col("source").isin("raw", "hot")
    rows = archive.where((F.col("ts") >= t_from) & (F.col("ts") < t_to)).select("channel", "ts", "val", "quality")
    rows = rows.join(route.where(is_raw).select("channel", F.col("n").alias("r_n"), "t0", "t1", "n_known"), "channel")
    rows = rows.where((F.col("r_n") <= m) | F.col("val").isNotNull())
    # ranges up to m rows stand alone in the selection, as those with few rows for its buckets do
    spans = F.when(F.col("r_n") <= m, F.lit(0)).otherwise(F.col("n_known"))
    raw_points = preselected(rows.withColumn("n", spans), max(1, math.ceil(chart.rho * m / 2)), ["channel", "ts", "val", "quality"])
    chosen = levels.join(route.where(F.col("source") == "agg").select("channel", F.col("level").alias("lvl")), ["channel", "lvl"])
    agg_points = minmax_points(chosen.where((F.col("bucket") + _width(grid) > t_from) & (F.col("bucket") < t_to)), t_from, t_to)
    points = lttb(raw_points.unionByName(agg_points.withColumn("quality", F.lit(None).cast("string"))), m)
    returned = F.count("*").over(Window.partitionBy("channel"))
    points = points.withColumn("q_returned", returned)
    out = route.select("channel", "source", "level", "n", "m").join(points, "channel", "left")
    eta = F.when(F.col("n") == 0, 0.0).otherwise(reduction_ratio(F.col("n"), F.coalesce("q_returned", F.lit(0))))
    return out.select("channel", "ts", "val", "quality", "source", "level", "n", "m", eta.alias("eta"))


def series_with_layers(series: DataFrame, **layers: DataFrame) -> DataFrame:
    """The series and its layers in one table, told apart by layer."""
    out = series.withColumn("layer", F.lit("series"))
    for name, df in layers.items():
        out = out.unionByName(df.withColumn("layer", F.lit(name)), allowMissingColumns=True)
    return out
