"""Bounded walks over a directed graph of edges (caller, callee), by frontier joins.

A round joins the frontier with the edges, drops what was seen and is checkpointed, so plans stay short and
lost executors cost one round. Defined results: null ends are no edges; repeated edges count once; a start
that no edge names is a walk of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veinstone.session import cut


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("caller", "callee").filter("caller is not null and callee is not null").distinct()


def neighbours(edges: DataFrame, node: str, direction: str) -> DataFrame:
    """Direct callees (``out``) or callers (``in``) of a node."""
    own, other = ("caller", "callee") if direction == "out" else ("callee", "caller")
    return edges.filter(F.col(own) == node).select(F.col(other).alias("node")).distinct()


def walk(edges: DataFrame, start: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """node, depth: everything within depth steps of the start nodes (column node), with the least number of steps.

    direction ``out`` follows calls, ``in`` goes to callers, ``any`` both in every step.
    """
    out = edges.select(F.col("caller").alias("node"), F.col("callee").alias("next"))
    back = edges.select(F.col("callee").alias("node"), F.col("caller").alias("next"))
    steps = {"out": out, "in": back, "any": out.unionByName(back)}[direction]
    seen = cut(start.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        frontier = seen.filter(F.col("depth") == step - 1).select("node")
        fresh = steps.join(frontier, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        fresh = cut(fresh.withColumn("depth", F.lit(step)))
        if not fresh.head(1):
            break
        seen = seen.unionByName(fresh)
    return seen


def dependency_graph(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth, relationship: root, callee, caller, or both for what is reached in either direction."""
    down = walk(edges, start, depth, "out").withColumnRenamed("depth", "down")
    up = walk(edges, start, depth, "in").withColumnRenamed("depth", "up")
    kind = F.when(F.least("down", "up") == 0, "root").when(F.col("down").isNotNull() & F.col("up").isNotNull(), "both").when(F.col("down").isNotNull(), "callee").otherwise("caller")
    return down.join(up, "node", "full").select("node", F.least("down", "up").alias("depth"), kind.alias("relationship"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (column node)."""
    keys = nodes.select("node").distinct()
    return edges.join(keys.withColumnRenamed("node", "caller"), "caller", "left_semi").join(keys.withColumnRenamed("node", "callee"), "callee", "left_semi")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left when sources and sinks were taken off again and again: empty if and only if there is no cycle.

    A round takes one layer off at either end, so there are half as many rounds as the longest path off cycles has edges.
    """
    left = cut(distinct_edges(edges))
    size = left.count()
    while True:
        callers, callees = left.select(F.col("caller").alias("n")).distinct(), left.select(F.col("callee").alias("n")).distinct()
        both = callers.join(callees, "n", "left_semi")
        kept = cut(induced(left, both.withColumnRenamed("n", "node")))
        now = kept.count()
        left = kept
        if now == size:
            return left
        size = now


def missing_records(edges: DataFrame, start: DataFrame, present: DataFrame, described: DataFrame, depth: int) -> DataFrame:
    """node, depth, relationship of what a walk down meets that present has (column node) and described lacks."""
    met = walk(edges, start, depth, "out").join(present.select("node").distinct(), "node", "left_semi").join(described.select("node").distinct(), "node", "left_anti")
    return met.withColumn("relationship", F.when(F.col("depth") == 0, "direct").when(F.col("depth") == 1, "callee").otherwise("transitive"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in."""
    ends = edges.select(F.col("caller").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("callee").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
