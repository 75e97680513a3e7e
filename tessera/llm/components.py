"""Connected components of an edge table, by minimum labels with pointer jumping.

Edges and labels stay distributed; each round is two joins and a map-side
combined minimum, and ends in a table in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import write_scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Null ends and loops are ignored.

    An empty edge table gives an empty result.
    """
    both = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = write_scratch(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = write_scratch(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("component").alias("seen"))
        low = both.join(seen, "other").groupBy("node").agg(F.min("seen").alias("low"))
        step = labels.join(low, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        now = write_scratch(step.join(jump, "next", "left").select("node", "was", F.least("next", "further").alias("component")), "labels")
        labels = now.select("node", "component")
        if now.where(F.col("component") != F.col("was")).isEmpty():
            return labels
