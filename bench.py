"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom import model
from chronoloom.functions.scalar import micros
from chronoloom.operators import grid
from chronoloom.params import HOUR
from chronoloom.plans import catalog

HEADLINE = ("bucket_aggregate", "multi_level_aggregate", "hampel_filter", "window_features", "channel_pipeline", "build_episodes", "minmax_lttb", "series_query", "dedup_last", "tile_pack", "alarm_hysteresis")


def lineitem_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket_aggregate over the largest table, a channel for each supplier."""
    rows = model.table(spark, sf_dir, "lineitem")
    rows = rows.select(F.col("l_suppkey").cast("string").alias("channel"), (micros(F.col("l_shipdate")) + F.col("l_orderkey")).alias("ts"), F.col("l_extendedprice").alias("val"))
    return grid.bucket_aggregate(rows, 24 * HOUR)


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: catalog.QUERIES[n] for n in HEADLINE} | {"bucket_aggregate_lineitem": lineitem_buckets}
    took: dict[str, float] = {}
    for name, f in todo.items():
        times = []
        for _ in range(runs + 1):  # the first warms up
            began = time.perf_counter()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
