"""Connected components of an undirected graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stalemark.llm.frames import write_through


def _settled(edges: DataFrame) -> bool:
    """Does every node hang on one node at most, which hangs on none? Then each hangs on its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    most, both = nodes.agg(F.max("out"), F.max(F.least("out", "into"))).first()
    return most is None or (most <= 1 and both == 0)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node on the smallest of them all: the larger ones, or the smaller ones and itself."""
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    if large:  # a node may have very many larger neighbours; this join has a shuffle of its own, which can split it
        least = write_through(least, "least")
    joined = around.join(least, F.col("a") == F.col("node"))
    if large:
        made = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return made.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b) to another; the component is its smallest node.

    A large star and a small star in turn, until every node hangs on its component directly. The rounds grow as a
    logarithm of the graph. Each is a table in the shared folder, so plans stay short.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = write_through(ordered.distinct(), "edges")
    while not _settled(now):
        now = write_through(_star(_star(now, large=True), large=False), "edges")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
