"""Connected components of a table of links: large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v): the smallest node that it reaches.

    Each round hangs nodes on smaller ones and only shortens paths; a handful of rounds suffice for deep chains, too.
    Links of a node are only ever reduced to their minimum, which is combined before the shuffle.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    before = None
    while True:
        # large star: every larger neighbour of a node hangs on the node's least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours hang on the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(moved.filter("u > v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if not now[0] or (now[0] == now[2] and tuple(now) == before):
            break
        before = tuple(now)
    parents = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return parents.unionByName(parents.select(F.col("component").alias("node"), "component").distinct())
