"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (columns a, b); written.

    Each turn ties the larger neighbours of a node to its least one, then the smaller ones, until every edge
    leads to a component's smallest node: a logarithmic number of turns in practice. Least neighbours are summed
    before they are shuffled, and written, so that the joins with hot nodes are plain and AQE can split them.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = materialise(_least(both).withColumn("m", F.least("u", "m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct())
        down = materialise(_least(large))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(small.select("e.u", "e.v").filter("u <> v").distinct())
        for t in (edges, least, large, down):
            discard(t)
        edges = after
        new = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(members.select("component", "component").distinct())


def roots(parents: DataFrame) -> DataFrame:
    """node and root for every node of parents (node, parent), one parent each and no cycles: pointers that double."""
    now = materialise(parents.select("node", F.col("parent").alias("root")))
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = materialise(now.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        now = after.drop("moved")
        if not after.agg(F.max("moved")).first()[0]:
            return now
