"""Connected components of a graph given as edges, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): the label is the least node of its component.

    Labels spread to neighbours and then to the label's own label, so distances halve in each round; a round's labels
    are written in the shared folder. Nodes may be of any type that has an order. Sums are partial before the
    shuffle, and a hub's edges are a skewed join side that adaptive execution splits.
    """
    ends = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.filter(F.col("a") != F.col("b")).select(F.explode(ends).alias("e")).select("e.a", "e.b")
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    turn, table = 0, labels
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = hooked.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) < F.col("label")).alias("changed"))
        moved = materialize(moved, f"labels{turn}")
        drop(table)
        table, labels = moved, moved.select("node", "label")
        if moved.filter("changed").isEmpty():
            drop(both)
            return labels
