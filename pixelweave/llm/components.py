"""Distributed connected components by alternating large-star and small-star steps.

Every step is a minimum by node, pre-aggregated, joined back to the edges; no node's neighbours are ever collected.
Each round's edges are written to the shared folder, so lineage stays short and lost executors cost no rerun. It
ends when a round leaves the edges as they were; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each node's larger (large) or smaller neighbours are linked to the smallest of it and them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v), component being the smallest node reachable."""
    nodes = cut(edges.where("u is not null and v is not null").select("u", "v").distinct(), "edges")
    now = cut(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = None
    while True:
        n, h = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, h) == mark or n == 0:
            break
        mark = (n, h)
        after = cut(_star(_star(now, True), False), "stars")
        discard(now)
        now = after
    own = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return own.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")).groupBy("node").agg(F.min("m").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
