"""Connected components of a link table, by spreading minima and jumping pointers. Nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import materialised


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b): (node, component), the smallest node reachable, for every node with a link.

    Each round a node takes the least label among itself and its neighbours, then the label of that
    label. The rounds grow with the logarithm of a component's diameter, not with its size. Aggregates
    combine before the shuffle, so a node with very many links costs a task no more than its partial sums.
    Labels grow with the links, so no side is broadcast.
    """
    edges = materialised(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialised(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        around = edges.join(labels.hint("merge"), edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(around.hint("merge"), labels["node"] == around["a"]).select("node", F.least("component", "least").alias("next"), F.col("component").alias("was"))
        step = materialised(step)
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("beyond"))
        after = step.join(jump.hint("merge"), step["next"] == jump["at"]).select("node", F.least("next", "beyond").alias("component"), (F.col("was") != F.least("next", "beyond")).alias("moved"))
        after = materialised(after)
        labels = after.select("node", "component")
        if after.filter("moved").isEmpty():
            return labels
