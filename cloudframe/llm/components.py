"""Connected components by spreading least labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.shared import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src bigint, dst bigint); component is the least node in it.

    Each round takes the least label among a node's neighbours and then the label of its
    label, so the rounds grow with the logarithm of the longest path. Rounds are written to
    the shared folder. The driver sees a count only. No edges: no rows. The result is a table
    of the shared folder, for the caller to discard().
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        met = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        roots = met.select(F.col("node").alias("component"), F.col("component").alias("root"))
        before, labels = labels, materialize(met.join(roots, "component").select("node", "old", F.col("root").alias("component")))
        discard(before)
        if labels.where("old <> component").isEmpty():
            discard(both)
            found = labels.select("node", "component")
            found._shared_path = labels._shared_path
            return found
