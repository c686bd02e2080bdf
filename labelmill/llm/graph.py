"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import materialize, small

MOVES = 200_000  # labels of two longs each that may be sent to all tasks


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for each end of ``edges (a, b)``: label is the smallest id reachable.

    Each round takes the smallest label of the neighbours and then the label of that label, so that the rounds grow with the
    logarithm of a chain's length. Labels are written to the shared folder after each round; it ends when none changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialize(lower, "lower")
        # A large component's rows all have one label: the labels that move are few, so they go to the rows.
        target = lower.where("label < id").select(F.col("id").alias("label"), F.col("label").alias("next"))
        target = materialize(target.join(lower.select("label").distinct(), "label", "left_semi"), "moves")
        target = F.broadcast(target) if small(target, MOVES) else target
        new = materialize(lower.join(target, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("label < old").isEmpty():
            return labels
