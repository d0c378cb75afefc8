"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.session import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); the component is its smallest node.

    In each round every node points to its smallest neighbour, pointers are followed twice and edges are renamed to
    where their ends point, so the graph shrinks until no edge is left. A node of any degree is one row of a
    partial minimum; rounds are written as tables, which go when the next round stands. The result is a written table.
    """
    edges = materialise(edges.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = materialise(ends.groupBy("u").agg(F.min("v").alias("_p")).select(F.col("u").alias("node"), F.least("u", "_p").alias("parent")))
        parents = nearest
        for _ in range(2):
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
            parents = parents.join(above, "parent").select("node", F.col("_above").alias("parent"))
        parents, before = materialise(parents), (labels, edges)
        release(nearest)
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            moved = parents.select(F.col("node").alias("component"), "parent")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = materialise(labels)
        edges = (
            edges.join(parents.select(F.col("node").alias("u"), F.col("parent").alias("_u")), "u")
            .join(parents.select(F.col("node").alias("v"), F.col("parent").alias("_v")), "v")
            .filter("_u != _v")
            .select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
        )
        edges = materialise(edges.distinct())
        release(parents, *before)
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    smallest = labels.groupBy("component").agg(F.min("node").alias("_least"))
    final = materialise(labels.join(smallest, "component").select("node", F.col("_least").alias("component")))
    release(labels, edges)
    return final
