"""Running values over a key's rows without sorting a key in one task.

Rows are cut into chunks (c_chunk) that ascend with the order. A chunk is summed up in one value, the values are
carried over the chunks of a key (a row for each chunk), and windows are taken inside chunks only. A key with a third
of all rows is spread over as many tasks as it has chunks. Each function reads its rows twice, so hand in stored rows
where they are costly to make and several functions follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.scalar import floor_div


def chunked(rows: DataFrame, order: Column, size: int) -> DataFrame:
    """rows with c_chunk; nothing is kept of rows without a key or an order."""
    return rows.withColumn("c_chunk", floor_div(order, size))


def _carried(rows: DataFrame, keys: tuple[str, ...], of_chunk: Column, over_chunks: Callable[[Column, WindowSpec], Column]) -> DataFrame:
    """rows with c_in: over_chunks(the value of each chunk, the key's chunks in order)."""
    chunks = rows.groupBy(*keys, "c_chunk").agg(of_chunk.alias("c_sum"))
    carried = over_chunks(F.col("c_sum"), Window.partitionBy(*keys).orderBy("c_chunk"))
    return rows.join(chunks.select(*keys, "c_chunk", carried.alias("c_in")), [*keys, "c_chunk"])


def _inside(keys: tuple[str, ...], order: str) -> WindowSpec:
    return Window.partitionBy(*keys, "c_chunk").orderBy(order)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def largest_before(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, out: str) -> DataFrame:
    """The largest value of the rows before; null for a key's first row."""
    carried = _carried(rows, keys, F.max(value), lambda s, w: F.max(s).over(_before(w)))
    return carried.withColumn(out, F.greatest("c_in", F.max(value).over(_before(_inside(keys, order))))).drop("c_in")


def number(rows: DataFrame, keys: tuple[str, ...], order: str, out: str) -> DataFrame:
    """The row's number in its key, from 0."""
    carried = _carried(rows, keys, F.count("*"), lambda s, w: F.sum(s).over(_before(w)))
    return carried.withColumn(out, F.coalesce("c_in", F.lit(0)) + F.row_number().over(_inside(keys, order)) - 1).drop("c_in")


def following(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, out: str) -> DataFrame:
    """The value of the next row; null for a key's last row."""
    carried = _carried(rows, keys, F.min_by(F.struct(value), order), lambda s, w: F.lead(s).over(w))
    one = F.lead(F.struct(value)).over(_inside(keys, order))
    return carried.withColumn(out, F.coalesce(one, "c_in")[value]).drop("c_in")


def preceding(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, out: str) -> DataFrame:
    """A struct with the value of the row before; a null struct for a key's first row."""
    carried = _carried(rows, keys, F.max_by(F.struct(value), order), lambda s, w: F.lag(s).over(w))
    return carried.withColumn(out, F.coalesce(F.lag(F.struct(value)).over(_inside(keys, order)), "c_in")).drop("c_in")


def last_known(rows: DataFrame, keys: tuple[str, ...], order: str, mark: str, out: str) -> DataFrame:
    """The last mark that isn't null, up to this row."""
    known = F.max_by(mark, F.when(F.col(mark).isNotNull(), F.col(order)))
    carried = _carried(rows, keys, known, lambda s, w: F.last(s, ignorenulls=True).over(_before(w)))
    so_far = F.last(mark, ignorenulls=True).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return carried.withColumn(out, F.coalesce(so_far, "c_in")).drop("c_in")


def sum_so_far(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, out: str) -> DataFrame:
    """The sum of the values up to this row."""
    carried = _carried(rows, keys, F.sum(value), lambda s, w: F.sum(s).over(_before(w)))
    so_far = F.sum(value).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return carried.withColumn(out, F.coalesce("c_in", F.lit(0)) + so_far).drop("c_in")
