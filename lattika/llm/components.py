"""Connected components of a graph given by its edges, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for each node of ``edges`` (u, v: long, no nulls).

    A large-star step links each node's greater neighbours to its least one, a small-star step its lesser ones; when neither
    changes anything, each component is a star around its root. A step's least neighbours come from an aggregation that is
    written first, so its join is one of two plain tables, which Spark splits where one node has most edges. The edges
    never grow in number, spent tables are deleted, and only counts and sums reach the driver.
    """
    e, state = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()), None
    while True:
        new = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == state or not new[0]:
            break
        state = new
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        lesser = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = cut(large.join(lesser, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        free(e, least, large, lesser)
        e = small
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = cut(nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    free(e)
    return out
