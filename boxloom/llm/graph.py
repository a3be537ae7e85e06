"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that
    label, so long chains shrink by halves; labels live in stored tables, not on the driver.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = stored(edges)
    labels = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a").agg(F.min("component").alias("near"))
        )
        nearer = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("over"))
        moved = stored(
            nearer.join(jump, "component", "left").select(
                "node", "was", F.least("component", F.coalesce("over", "component")).alias("component")
            )
        )
        labels = moved.select("node", "component")
        if moved.filter("component < was").isEmpty():
            return labels
