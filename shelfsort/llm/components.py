"""Connected components of an edge table, by checkpointed rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable): one row per node of ``edges`` (a, b).

    Each round a node takes the smallest label among its neighbours and its
    own, and then its label's label (pointer jumping), so the number of rounds
    grows with the logarithm of the longest path, and a round moves one row per
    edge and node.  Rounds go on until nothing changes; there is no cap.
    Aggregates combine before the shuffle, so a node of many edges is no single
    task's work; AQE splits its join partition.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both)
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
                         .select(F.col("a").alias("node"), "label"))
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
                .select(F.col("a").alias("node"), "near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialise(step.join(jump, "label", "left")
                           .select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = step.select("node", "label")
        if not step.agg(F.max(F.col("old") != F.col("label"))).first()[0]:
            return labels
