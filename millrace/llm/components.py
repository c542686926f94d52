"""Connected components of an edge table by alternating stars.

Each round joins edges with the least neighbour of one end, twice. Minima come from partial aggregates, and both sides of each join
are plain tables, so that adaptive execution can split the rows of a hub. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _rewired(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v): each v gets an edge to the least of u and u's neighbours, and so does u itself; loops go."""
    least = scratch.keep(edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    kept = scratch.keep(out.filter("u != v").distinct())
    scratch.drop(least)
    return kept


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: for each node of edges (u, v), the least node of its component. An empty table gives no rows."""
    now = scratch.keep(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        large = _rewired(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), scratch)
        small = _rewired(large.filter("u > v"), scratch)
        state = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(now, large)
        now = small
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
