"""Connected components of a table of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.store import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the smallest node it is joined with.

    Each round a node takes the smallest label among its own and its neighbours', and then the label of
    that label's node, so that a chain shortens by half. What changes is counted, nothing is collected.
    Only aggregates with partial sums touch a hub's links; the joins split skewed keys.
    """
    both = work.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = work.write(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        lower = work.write(lower)
        roots = lower.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped = lower.join(roots, lower["label"] == roots["root"]).select("node", "old", F.least("label", "above").alias("label"))
        after = work.write(jumped)
        changed = after.where("label <> old").limit(1).count()
        work.drop(lower, labels)
        labels = after.select("node", "label")
        labels._workspace_path = after._workspace_path
        if not changed:
            work.drop(both)
            return labels
