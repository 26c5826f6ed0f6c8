"""Distributed union-find: the smallest node that links reach, for every node with a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in `edges`; component is the smallest node reachable.

    Each round hooks the component of a node to the smallest component beside it and then
    jumps one pointer further, so long chains halve.  The state is one row for each node,
    written to the shared folder every round; links between nodes of one component are dropped on
    the way.  Nothing but counts reaches the driver."""
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    links = materialize(links)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    state = nodes.withColumn("component", F.col("node"))
    while True:
        # links between components, as they stand
        of_a = state.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        of_b = state.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        links = materialize(links.join(of_a, "a").join(of_b, "b")
                            .select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b"))
                            .where("a <> b").distinct())
        if links.isEmpty():
            return state
        # every component with a smaller neighbour hooks to its smallest; the hooks form a
        # forest (each points to a smaller node), flattened by pointer jumping
        parent = links.groupBy("a").agg(F.min("b").alias("parent")).withColumnRenamed("a", "node")
        parent = materialize(parent)
        while True:
            above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            jumped = materialize(parent.join(above, "parent", "left").select(
                "node", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")))
            parent = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        roots = parent.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        state = materialize(state.join(roots, "component", "left")
                            .select("node", F.coalesce("root", "component").alias("component")))
