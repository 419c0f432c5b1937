"""Connected components of a link table, by alternating large-star and
small-star steps (Kiveris et al., Connected Components in MapReduce)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import release, stash


#: Links of a written part; later steps never have more links than the first.
LINKS = 200_000


def _least(edges: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Each (u, v) with the least neighbour of u. An aggregate that is combined
    before the shuffle and a join with the written result, which Spark can split
    at a hub, rather than a window, which would take its links to one task."""
    low = stash(edges.groupBy("u").agg(F.min("v").alias("m")), parts)
    return edges.join(low, "u"), low


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v only, which is itself no u: then each star is a
    component, and its v the smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (columns a, b: longs); the
    component is its smallest node. Nodes without links don't appear."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    parts = 1 + edges.count() // LINKS
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, low = _least(both, 2 * parts)
        large = joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small-star: u > v holds, so every neighbour here is the smaller one
        large = stash(large, parts)
        release(low)
        small, low = _least(large, parts)
        down = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, stash(down.unionAll(small.select("u", F.col("m").alias("v"))).distinct(), parts)
        release(old, large, low)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
