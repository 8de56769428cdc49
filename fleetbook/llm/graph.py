"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.llm.common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """(of, low): the smallest of every node and its neighbours ``b``; edges are (a, b)."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return stored(low.select(F.col("a").alias("of"), F.least("a", "low").alias("low")), "cc-low")


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable; ``links`` has long columns
    a, b in any order.  Nodes without links are not listed.

    A round replaces the neighbours of a node by links to the smallest of them: first the larger
    neighbours, then the smaller ones.  Rounds end when the links stay the same: stars around the
    smallest node of each component.  The per-node minimum is written as a table, so the join
    back is one Spark can split at a node that holds a large part of the links.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "cc")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both)
        large = both.filter("b > a").join(low, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "cc")            # a > b throughout
        low = _lowest(large)
        joined = large.join(low, F.col("a") == F.col("of"))
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select(F.col("of").alias("a"), F.col("low").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "cc")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
