"""Stored tables of telemetry, flags and aggregates: partitions by time, upserts, compaction, retention.

Rows are appended under a batch number and the last one of a key holds (merge on read). Partitions are named by the time
of their rows, so ranges read only the partitions they meet, compaction rewrites only those that have several batches,
and retention deletes whole partitions by name without reading a row. Each table has its own time to live.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..params import DAY
from ..storage import exists, put
from .archive import in_range, latest

EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class Stored:
    """A table under a path: the keys that tell rows apart, the column with their time, and what a partition is: a day or
    a month, below the columns ``under``."""

    path: str
    keys: tuple[str, ...]
    unit: str = "day"
    time: str = "ts"
    under: tuple[str, ...] = ()

    @property
    def by(self) -> tuple[str, ...]:
        return (*self.under, self.unit)

    def _part(self, micros: Column) -> Column:
        """A partition's name, as text that sorts by time: its day, or its month."""
        return F.date_format(F.date_from_unix_date(floor_div(micros, DAY).cast("int")), "yyyy-MM-dd" if self.unit == "day" else "yyyy-MM")

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Append rows under a batch number. A batch that is repeated changes nothing for readers."""
        put(rows.withColumn(self.unit, self._part(F.col(self.time))).withColumn("batch_id", F.lit(batch_id).cast("long")), self.path, *self.by)

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.path).parquet(self.path).withColumn(self.unit, F.col(self.unit).cast("string"))

    def within(self, t_from: int | None, t_to: int | None) -> Column:
        """A range as a condition on partitions, and on rows inside of them."""
        found = in_range(t_from, t_to, self.time)
        found = found & (F.col(self.unit) >= self._part(F.lit(t_from))) if t_from is not None else found
        return found & (F.col(self.unit) <= self._part(F.lit(t_to - 1))) if t_to is not None else found

    def scan(self, spark: SparkSession, t_from: int | None = None, t_to: int | None = None) -> DataFrame:
        """Rows of a half-open range, the last version of each key, without the columns of storage."""
        return latest(self._stored(spark).where(self.within(t_from, t_to)), self.keys, "batch_id").drop("batch_id", self.unit)

    def compact(self, spark: SparkSession) -> int:
        """Rewrite the partitions that have several batches with the last version of each key; how many there were. The
        partitions are replaced when the job commits, readers see the old or the new ones."""
        rows = self._stored(spark)
        several = rows.groupBy(*self.by).agg(F.min("batch_id").alias("a"), F.max("batch_id").alias("b")).where("a <> b").select(*self.by).collect()  # a row a partition
        if several:
            mine = F.lit(False)
            for part in several:
                mine = mine | _same(part.asDict())
            kept = latest(rows.where(mine), self.keys, "batch_id").hint("rebalance", *self.by)
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(self.path)
        return len(several)

    def partitions(self, spark: SparkSession) -> list[tuple[str, str]]:
        """(name, path) of each partition: the name is its day or month."""
        if not exists(spark, self.path):
            return []
        hadoop, found = spark._jvm.org.apache.hadoop.fs, []
        root = hadoop.Path(self.path)
        fs, level = root.getFileSystem(spark._jsc.hadoopConfiguration()), [root]
        for column in self.by:
            level = [f.getPath() for p in level for f in fs.listStatus(p) if f.isDirectory() and f.getPath().getName().startswith(column + "=")]
        for p in level:
            found.append((p.getName().split("=", 1)[1], p.toString()))
        return sorted(found)

    def drop_before(self, spark: SparkSession, ts: int) -> list[str]:
        """Delete the partitions that lie before a time as a whole; their names. The partition that holds the time stays."""
        first = _name(ts, self.unit)
        gone = [(name, path) for name, path in self.partitions(spark) if name < first]
        for _, path in gone:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        return sorted({name for name, _ in gone})

    def retain(self, spark: SparkSession, ttl: int) -> int | None:
        """Delete what is older than ``ttl`` before the newest row, by whole partitions; returns that time. Only the last
        partition is read. A scan from the returned time on leaves out the rest."""
        names = self.partitions(spark)
        if not names:
            return None
        newest = self._stored(spark).where(F.col(self.unit) == names[-1][0]).agg(F.max(self.time)).first()[0]
        self.drop_before(spark, newest - ttl)
        return newest - ttl


def _same(part: dict) -> Column:
    out = F.lit(True)
    for column, value in part.items():
        out = out & (F.col(column) == value)
    return out


def _name(ts: int, unit: str) -> str:
    day = date.fromordinal(EPOCH.toordinal() + ts // DAY)
    return day.isoformat() if unit == "day" else day.isoformat()[:7]


def telemetry(path: str, *identity: str) -> Stored:
    """Rows of a channel by time; ``identity`` tells those apart that have one time and are all to stay."""
    return Stored(path, ("channel", "ts", *identity))


def flags(path: str) -> Stored:
    return Stored(path, ("channel", "ts", "run"))


def aggregates(path: str) -> Stored:
    return Stored(path, ("channel", "lvl", "bucket"), "month", "bucket", ("lvl",))
