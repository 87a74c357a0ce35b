"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stanzaflow.llm.scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b), as longs.

    Each round points every node at its smallest neighbour or itself and contracts along these pointers, which
    at least halves the nodes that have edges; the smallest node of a component is never contracted away.
    Minima are taken map-side first, and the joins read written tables, so that adaptive execution can split
    the rows of a node with very many edges. Rounds grow with the logarithm of the longest chain.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges)
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        step = materialise(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("to")))
        rounds.append(step)
        moved = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").filter("x <> y")
        edges = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds.pop()
    for step in reversed(rounds):
        later = labels.toDF("to", "last")
        labels = materialise(step.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to")))
    return labels.toDF("node", "component")
