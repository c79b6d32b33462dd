"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of a link; the component is its least node.

    Every round takes the least label among a node's neighbours and then the
    label of that label, so rounds grow with the logarithm of a component's
    width; each round's labels are cut from their lineage.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node != other").distinct())
    label = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    while True:
        seen = both.join(label.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = label.join(seen, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("next"), F.col("component").alias("further"))
        step = cut(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("component"), "was"))
        if step.where("component != was").isEmpty():
            return step.select("node", "component")
        label = step.select("node", "component")
