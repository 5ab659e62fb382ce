"""Connected components of a table of links, by alternating large and small stars.

Every step is a minimum per node and a join; hubs are combined map-side and split by the runtime
where a join is skewed. Neither links nor components ever reach the driver; only a count and a
checksum do, to see that nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop, staged


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (the component's least node) of all nodes of links (a, b: long)."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = _checksum(edges)
    while True:
        # Large star: each larger neighbour of u is linked with the least of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours are linked with the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = staged(small, "edges")
        drop(edges)
        edges, before = after, mark
        mark = _checksum(edges)
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
