"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links(a, b) but the roots themselves.

    Each round points every node's larger neighbours to its smallest neighbour, then does the same among smaller
    ones; stars remain after a number of rounds that grows with the logarithm of the longest path. Rounds are cut by
    written tables. Nothing is collected but two numbers a round."""
    edges = materialize(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen or now[0] == 0:
            return edges
        seen = now
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m_least"))
        least = least.select("node", F.least("node", "m_least").alias("m_least"))
        large = both.join(least, "node").where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("m_least").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m_least"))
        small = large.join(least, "node").where(F.col("root") != F.col("m_least")).select(F.col("root").alias("node"), F.col("m_least").alias("root"))
        before, edges = edges, materialize(small.unionByName(least.withColumnRenamed("m_least", "root")).distinct())
        release(before)
