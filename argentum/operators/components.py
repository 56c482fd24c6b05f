"""Connected components of links kept in tables: large and small stars, a few jobs whatever the groups' shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.plans.shared import cut


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component), the least node reachable; nodes without a link are left out.

    Each round hangs every node's larger neighbours on its least neighbour, then the smaller ones;
    a node's least neighbour is an aggregate, so no node's neighbours are gathered. Links that are
    null or join a node with itself don't count. Empty links give no row.
    """
    edges = cut(_ordered(links.select("a", "b")), "links")
    while True:
        edges = cut(_small(_large(edges)), "links")
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("a", F.lit(0), F.lit(1)))
        mixed = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or below > 0 and above > 0")
        if not mixed.agg(F.count("*")).first()[0]:  # every node hangs on one other, which hangs on none
            break
    # Now every component is a star around its least node.
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _turned(e: DataFrame) -> DataFrame:
    return e.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _ordered(e: DataFrame) -> DataFrame:
    return _turned(e).distinct()


def _large(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _turned(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b"))


def _small(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the least of them."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    joined = e.join(least, "b")
    return _ordered(joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b")))
