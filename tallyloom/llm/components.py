"""Connected components of a large graph by alternating large and small stars.

Each round hangs every node's larger neighbours on its smallest neighbour, then every node's smaller neighbours too;
rounds grow with the logarithm of the longest chain. Edges are never gathered by node: the smallest neighbour is an
aggregate, and hubs are met in a plain equi-join, whose skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, drop


def _hung(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Edges (u, v) where each neighbour v of u hangs on the smallest of u and its neighbours."""
    least = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star")
    joined = edges.join(least, "u")
    if larger_only:
        joined = joined.where("v > u")
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger_only:
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v), label being the smallest node it is connected to.

    u and v are longs; loops and repeated edges do no harm, and no edges give no rows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_hung(both, True), "large")
        small = cut(_hung(large, False), "small")
        after = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        drop(large)
        now = small
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
