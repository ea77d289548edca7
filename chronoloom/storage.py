"""Folders for data that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which executors and driver share. Where it is unset, a local folder if the
    master is local, too; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/s-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in a scratch folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(df: DataFrame, path: str, *by: str, mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def with_columns(schema: StructType, columns: dict[str, str]) -> StructType:
    """A new schema with columns (name: type) behind; StructType.add changes the frame's own."""
    found = StructType(list(schema.fields))
    for name, kind in columns.items():
        found.add(name, kind)
    return found
