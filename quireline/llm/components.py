"""Connected components of an edge table, by smallest labels and pointer jumping; nothing of it is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.storage import written


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``edges``: a, b of one orderable type. Returns node, comp (the smallest node it reaches) for every node with an edge.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so rounds grow with the logarithm of
    the longest path. Rounds are written to the shared folder; joins read them from there, so that Spark can split a hub's rows.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), tag)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), tag)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("low"))
        lower = written(labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp")), tag)
        target = lower.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        jumped = written(lower.join(target, "comp").select("node", "old", F.col("next").alias("comp")), tag)
        labels = jumped.select("node", "comp")
        if jumped.filter("old <> comp").isEmpty():
            return labels
