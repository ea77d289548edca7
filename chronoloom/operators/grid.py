"""Buckets, levels and tiles of the time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import floor_to, tile_end, tile_index
from ..params import Grid

FIELDS = ("vmin", "tmin", "vmax", "tmax", "vfirst", "tfirst", "vlast", "tlast", "vsum", "cnt")
#: A bucket's four points: smallest and largest value (the earliest of equal ones), first and last in time.
POINTS = {
    "p_min": lambda v, t: F.min(F.struct(v.alias("v"), t.alias("t"))),
    "p_max": lambda v, t: F.max(F.struct(v.alias("v"), (-t).alias("t"))),
    "p_first": lambda v, t: F.min(F.struct(t.alias("t"), v.alias("v"))),
    "p_last": lambda v, t: F.max(F.struct(t.alias("t"), v.alias("v"))),
}


def flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, F.col("p_min.v").alias("vmin"), F.col("p_min.t").alias("tmin"), F.col("p_max.v").alias("vmax"), (-F.col("p_max.t")).alias("tmax"),
        F.col("p_first.v").alias("vfirst"), F.col("p_first.t").alias("tfirst"), F.col("p_last.v").alias("vlast"), F.col("p_last.t").alias("tlast"), "vsum", "cnt",
    )


def bucket_aggregate(rows: DataFrame, width: int) -> DataFrame:
    """Rows (channel, ts, val) in buckets of a width: extremes, first, last, sum and count of values that aren't null."""
    v, t = F.col("val"), F.col("ts")
    points = [f(v, t).alias(n) for n, f in POINTS.items()]
    keyed = rows.where(v.isNotNull()).groupBy("channel", floor_to(t, width).alias("bucket"))
    return flat(keyed.agg(*points, F.sum(v).alias("vsum"), F.count("*").alias("cnt")), "channel", "bucket")


def combine(parts: DataFrame, *keys: str) -> DataFrame:
    """Rows of partial buckets become one row for each key. The operation is associative and has no order."""
    pairs = {"p_min": ("vmin", "tmin"), "p_max": ("vmax", "tmax"), "p_first": ("vfirst", "tfirst"), "p_last": ("vlast", "tlast")}
    points = [f(F.col(pairs[n][0]), F.col(pairs[n][1])).alias(n) for n, f in POINTS.items()]
    return flat(parts.groupBy(*keys).agg(*points, F.sum("vsum").alias("vsum"), F.sum("cnt").alias("cnt")), *keys)


def rollup_buckets(buckets: DataFrame, width: int) -> DataFrame:
    return combine(buckets.withColumn("bucket", floor_to(F.col("bucket"), width)), "channel", "bucket")


def multi_level_aggregate(rows: DataFrame, grid: Grid) -> DataFrame:
    """channel, lvl, bucket and the fields for all levels: raw rows once, the levels from level 0."""
    zero = bucket_aggregate(rows, grid.delta)
    levels = zero.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(grid.levels - 1))))
    widths = F.element_at(F.array(*(F.lit(grid.width(i)) for i in range(grid.levels))), F.col("lvl") + 1)
    return combine(levels.withColumn("bucket", floor_to(F.col("bucket"), widths)), "channel", "lvl", "bucket")


def merge_buckets(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored buckets with newly built ones added (also: seeding open buckets)."""
    keys = [c for c in stored.columns if c not in FIELDS]
    return combine(stored.unionByName(new), *keys)


def rebuild_aggregates(rows: DataFrame, grid: Grid, channels: tuple[str, ...], t_from: int, t_to: int) -> DataFrame:
    """All levels of channels over a range widened to borders of the coarsest buckets."""
    width = grid.width(grid.levels - 1)
    lo, hi = t_from // width * width, -(-t_to // width) * width
    return multi_level_aggregate(rows.where(F.col("channel").isin(*channels) & (F.col("ts") >= lo) & (F.col("ts") < hi)), grid)


def minmax_points(buckets: DataFrame, t_from: int, t_to: int) -> DataFrame:
    """The extremes of buckets as points (channel, ts, val) in a range, without repeats."""
    points = F.array(F.struct(F.col("tmin").alias("ts"), F.col("vmin").alias("val")), F.struct(F.col("tmax").alias("ts"), F.col("vmax").alias("val")))
    out = buckets.select("channel", F.explode(points).alias("p")).select("channel", "p.ts", "p.val")
    return out.where((F.col("ts") >= t_from) & (F.col("ts") < t_to)).distinct()


def overlapping_buckets(buckets: DataFrame, width: int, t_from: int, t_to: int) -> DataFrame:
    return buckets.where((F.col("bucket") + width > t_from) & (F.col("bucket") < t_to))


def channel_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.min("ts").alias("t_first"), F.max("ts").alias("t_last"))


def tiles(leveled: DataFrame, grid: Grid) -> DataFrame:
    """leveled with its tile and the tile's end."""
    widths = F.element_at(F.array(*(F.lit(grid.width(i)) for i in range(grid.levels))), F.col("lvl") + 1)
    out = leveled.withColumn("tile", tile_index(F.col("bucket"), widths, grid))
    return out.withColumn("t_end", tile_end(F.col("tile"), widths, grid))


def tile_closed(end: Column, watermark: Column, late: int) -> Column:
    return end <= watermark - late


def tile_pack(leveled: DataFrame, watermarks: DataFrame, grid: Grid, late: int) -> DataFrame:
    """channel, lvl, tile, rows (at most grid.tile buckets), closed."""
    row = F.struct(F.col("bucket").alias("ts"), *FIELDS)
    packed = tiles(leveled, grid).groupBy("channel", "lvl", "tile").agg(F.max("t_end").alias("t_end"), F.sort_array(F.collect_list(row)).alias("rows"))
    return packed.join(watermarks, "channel").select("channel", "lvl", "tile", "rows", tile_closed(F.col("t_end"), F.col("watermark"), late).alias("closed"))


def contiguous_runs(numbers: DataFrame, *keys: str, number: str = "tile") -> DataFrame:
    """Maximal runs of consecutive numbers: keys, first, last."""
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return numbers.select(*keys, number).distinct().withColumn("island", island).groupBy(*keys, "island").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("island")


def late_points(rows: DataFrame, grid: Grid, late: int) -> DataFrame:
    """channel, lvl, dropped: points whose bucket was closed when they came, with one flush after each packet.

    Points are counted by packet and finest bucket first; only those counts are looked at for each level."""
    counts = rows.groupBy("channel", "pkt", floor_to(F.col("ts"), grid.delta).alias("l_zero")).agg(F.count("*").alias("l_n"), F.max("ts").alias("l_top"))
    per_packet = counts.groupBy("channel", "pkt").agg(F.max("l_top").alias("t_top"))
    before = Window.partitionBy("channel").orderBy("pkt").rowsBetween(Window.unboundedPreceding, -1)
    marks = per_packet.withColumn("t_seen", F.max("t_top").over(before)).select("channel", "pkt", "t_seen")
    levels = F.array(*(F.struct(F.lit(i).alias("lvl"), F.lit(grid.width(i)).alias("width")) for i in range(grid.levels)))
    each = counts.join(marks, ["channel", "pkt"]).withColumn("l", F.explode(levels))
    gone = F.coalesce(floor_to(F.col("l_zero"), F.col("l.width")) < F.col("t_seen") - late - F.col("l.width"), F.lit(False))
    return each.groupBy("channel", F.col("l.lvl").alias("lvl")).agg(F.sum(F.when(gone, F.col("l_n")).otherwise(0)).alias("dropped"))


def spans_of(rows: DataFrame) -> DataFrame:
    """channel, t0, t1, n of the rows."""
    return rows.groupBy("channel").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"))


def minmax_preselect(rows: DataFrame, buckets: int) -> DataFrame:
    """Of each channel: first smallest and first largest value of equal-time buckets, and the first and last row, with
    all columns of rows (channel, ts, val and others).

    With a number of buckets not above 0, or with at least half as many buckets as rows, all rows stay."""
    return preselected(rows.join(spans_of(rows), "channel"), buckets, rows.columns)


def preselected(joined: DataFrame, buckets: int, columns: list[str]) -> DataFrame:
    """minmax_preselect of rows with their channel's t0, t1 and n."""
    place = F.floor(((F.col("ts") - F.col("t0")) * buckets) / (F.greatest(F.col("t1") - F.col("t0"), F.lit(1)) + 1))
    every = F.lit(buckets <= 0) | (2 * buckets >= F.col("n"))
    rest = F.struct(*(F.col(c) for c in columns if c != "channel"))
    # a dense channel's rows fall into buckets, with both ends of the channel beside; rows of others stand alone
    end = (F.col("ts") == F.col("t0")) | (F.col("ts") == F.col("t1"))
    v, t = F.col("val"), F.col("ts")
    cell = F.when(every, F.struct(t.alias("at"), F.lit(0).alias("kind"))).otherwise(F.struct(place.alias("at"), F.lit(1).alias("kind")))
    picked = joined.groupBy("channel", cell.alias("cell")).agg(
        F.min(F.struct(v, t, rest.alias("r"))).alias("a"), F.max(F.struct(v, (-t).alias("t"), rest.alias("r"))).alias("b"), F.collect_set(F.when(end & ~every, rest)).alias("ends")
    )
    points = F.array_distinct(F.concat(F.array(F.col("a.r"), F.col("b.r")), "ends"))
    return picked.select("channel", F.explode(points).alias("p")).select("channel", "p.*").select(*columns)
