"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfold.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``links (a, b)``: the smallest node reachable.

    Each round a node takes the least label among its own and its neighbours', and then
    its label's label, until no label changes. Labels and links stay tables; each round
    reads the stored table of the last. A node with very many links costs one row per
    task after partial aggregation.
    """
    # A node keeps the link to its least neighbour; its other smaller neighbours are linked
    # with that one instead. They are few, so what many nodes say of them is said once.
    own = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = F.min("b").over(Window.partitionBy("a")).alias("least")
    own = own.distinct().select("a", "b", least)
    own = own.select("a", F.col("least").alias("b")).union(
        own.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    )
    own = own.distinct()
    both = stored(own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    )
    while True:
        seen = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        nearer = labels.join(seen, "node").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = stored(
            nearer.join(far, "next", "left").select(
                "node", "label", F.least("next", "far").alias("next")
            )
        )
        moved = after.where("label != next").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
