"""Connected components of a graph of edges, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; component is its smallest node.

    Every round each node takes the smallest label among its neighbours and then the label of its
    label, so chains shorten by jumps.  Every round is written to the shared folder.
    The edges are best a table that is written already, since they are counted first.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", 2 * edges.count())
    rows = both.count()
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    table = labels = scratch.keep(first, "labels", rows)
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jumped"))
        after = scratch.keep(near.join(jump, "to").select("node", F.least("to", "jumped").alias("component"), "old"), "labels", rows)
        scratch.drop(table)
        table, labels = after, after.select("node", "component")
        if after.filter(F.col("component") != F.col("old")).isEmpty():
            scratch.drop(both)
            return labels
