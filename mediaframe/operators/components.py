"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.plans.storage import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: for every node of the undirected edges the smallest node it is connected to.

    Each round takes the smallest label among a node's neighbours and, from the third on, follows the
    label's own label too, so long chains need few rounds. Every round is a written table; the loop
    ends when no label changes. Self-loops and repeated or null-ended edges are harmless.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"), F.lit(True).alias("moved")), "labels")
    rounds = 0
    while labels.where("moved").limit(1).count():
        rounds += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        if rounds > 2:
            step = materialize(new, "labels-step")
            up = step.select(F.col("node").alias("up"), F.col("label").alias("label_up"))
            new = step.join(up, step.label == up.up).select("node", "was", F.least("label", "label_up").alias("label"))
        done = materialize(new.select("node", "label", (F.col("label") != F.col("was")).alias("moved")), "labels")
        if rounds > 2:
            release(step)
        release(labels)
        labels = done
    release(both)
    return labels.select("node", "label")
