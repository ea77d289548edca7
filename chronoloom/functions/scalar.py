"""Column functions: times, flags, quality, chart arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Grid

TRUE_WORDS = ("true", "t", "1", "yes")


def floor_to(ts: Column, width: Column | int) -> Column:
    """The start of the bucket that holds ts, for negative times too."""
    return ts - F.pmod(ts, F.lit(width) if isinstance(width, int) else width)


def floor_div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def micros(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp"))


def unit_scale(largest: Column) -> Column:
    """Factor to microseconds by the magnitude of a source's largest absolute time: s, ms, us or ns."""
    return F.when(largest < 1e11, 1e6).when(largest < 1e14, 1e3).when(largest < 1e17, 1.0).otherwise(1e-3)


def parse_time(text: Column) -> Column:
    """Microseconds as an integer, or ISO-8601 (UTC where no zone is given); null if neither."""
    return F.coalesce(text.try_cast("long"), F.unix_micros(text.try_cast("timestamp")))


def lenient_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def lenient_number(value: Column) -> Column:
    """A finite number or null."""
    return clean_value(value.cast("string").try_cast("double"))


def clean_value(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def quality(val: Column, nd: Column, otkl: Column, x_min: Column, x_max: Column) -> Column:
    outside = F.coalesce(val < x_min, F.lit(False)) | F.coalesce(val > x_max, F.lit(False))
    missing = val.isNull() | F.isnan(val) | F.coalesce(nd, F.lit(False))
    return F.when(missing, "bad").when(F.coalesce(otkl, F.lit(0)) != 0, "uncertain").when(outside, "uncertain").otherwise("good")


def is_valid(quality_: Column, val: Column) -> Column:
    return (quality_ != "bad") & val.isNotNull()


def shard_of(channel: Column, shards: int) -> Column:
    return F.pmod(F.crc32(channel.cast("binary")), F.lit(shards)).cast("int")


def rebase(ts: Column, first: Column, compress: float, offset: int) -> Column:
    """Times moved towards the first one by a factor, then shifted."""
    return (first + F.rint((ts - first) / F.lit(float(compress)))).cast("long") + F.lit(offset)


def target_points(n: Column, width: int, per_pixel: float) -> Column:
    return F.least(n, F.ceil(F.lit(per_pixel * width)).cast("long"))


def reduction_ratio(n: Column, m: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - m / F.nullif(n, F.lit(0))))


def select_level(t_from: Column, t_to: Column, m: Column, grid: Grid, rho: float) -> Column:
    """The coarsest level that still has rho * m extrema in the range."""
    span = F.greatest(t_to - t_from, F.lit(1)).cast("double")
    ratio = span / (F.greatest(m * F.lit(rho / 2), F.lit(1.0)) * F.lit(float(grid.delta)))
    level = F.floor(F.log(float(grid.base), ratio) + 1e-9).cast("int")
    return F.when(ratio < 1, 0).otherwise(F.least(F.greatest(level, F.lit(0)), F.lit(grid.levels - 1)))


def tile_index(ts: Column, width: Column | int, grid: Grid) -> Column:
    return floor_div(ts, width * grid.tile)


def tile_end(tile: Column, width: Column | int, grid: Grid) -> Column:
    return (tile + 1) * (width * grid.tile)


def tiles_covering(t_from: Column, t_to: Column, width: Column | int, grid: Grid) -> Column:
    return F.sequence(tile_index(t_from, width, grid), tile_index(F.greatest(t_to - 1, t_from), width, grid))


def grid_delta(window: Column, m: Column) -> Column:
    """A chart cell: window / m rounded up to 1, 2 or 5 times a power of ten."""
    raw = F.greatest(window / m, F.lit(1.0))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw) + 1e-12))
    step = raw / power
    return (power * F.when(step <= 1 + 1e-9, 1).when(step <= 2 + 1e-9, 2).when(step <= 5 + 1e-9, 5).otherwise(10)).cast("long")
