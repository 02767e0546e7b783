"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenlake.operators.skew import salted_join
from wrenlake.session import cut, drop


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each node reaches over the edges.

    nodes: (id); edges: (a, b), undirected, whose ends are nodes. Each round takes the smallest label among
    the neighbours and then the label of that label, so chains shrink by more than half a round. Nodes
    without edges are their own component; loops and repeated edges change nothing. Rounds end when no
    label changes; more than ``most_rounds`` raise.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both, "cc-edges")
    labels = cut(nodes.select("id", F.col("id").alias("component")).distinct(), "cc-labels")
    if both.isEmpty():
        return labels
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.join(near, labels["id"] == near["a"], "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        moved = salted_join(hop, jump, ["low"], F.col("id")).select("id", F.least("low", F.coalesce("far", "low")).alias("component"), F.col("component").alias("old"))
        new = cut(moved, "cc-labels")
        done = new.where("component <> old").isEmpty()
        drop(labels)
        if done:
            return new.select("id", "component")
        labels = new.select("id", "component")
        labels._wrenlake_path = new._wrenlake_path
    raise RuntimeError("the components did not settle")
