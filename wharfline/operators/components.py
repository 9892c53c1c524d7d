"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.shared import discard, join_hot, materialize


def is_star_forest(tree: DataFrame) -> bool:
    """Whether no node of the distinct edges (u, v) has two v or is both a u and a v: one shuffle of partial sums by node."""
    ends = tree.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return not nodes.agg(F.count_if(F.expr("up > 1 or (up > 0 and down > 0)"))).first()[0]


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, many): the least neighbour of each node and the number of its edges, from partial folds."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many")), "least")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b) but the roots; root is the least node reachable.

    Rounds fold by node with partial minima, and are written to the shared folder until every component is a star; a
    hub's minimum goes to the tasks that hold its edges.  Duplicate edges, loops and an empty table are fine.
    """
    tree = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not is_star_forest(tree):
        before = tree
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = join_hot(both, least, "u", many=F.col("many")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialize(large.distinct(), "large")
        near = _least(large)
        small = join_hot(large, near, "u", many=F.col("many")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        tree = materialize(small.where("u <> v").distinct(), "edges")
        discard(before, least, large, near)
    return tree.select(F.col("u").alias("node"), F.col("v").alias("root"))
