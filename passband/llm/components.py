"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node around: the larger ones, or the node and the smaller."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # A node may have a third of all nodes around it: minima are pre-aggregated, and the join back
    # is left to Spark, which splits skewed partitions.
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: of every node of ``edges`` (u, v: bigint) the smallest node it reaches.

    Each round at least halves the longest chain and is written out, so that neither lineage nor a
    lost executor matters.  The rounds end when a written round equals the one before.
    """
    now, seen = stored(edges.filter("u <> v").distinct()), None
    while True:
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        now = stored(_star(_star(now, large=True), large=False))
