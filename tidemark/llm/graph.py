"""Connected components of a link table, by repeated Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component``: the smallest id that each end of a link (``a, b``) can reach.

    Every round an id takes the smallest label among its own and its neighbours', then the label of that label.
    Neighbours' labels are reduced before they are shuffled, so a node with very many links is no hot group. Each
    round is written to the shared folder; only the number of changed labels comes to the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialise(both.distinct(), "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component"))
    labels = materialise(labels, "labels")
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        near = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        of_label = labels.select(F.col("id").alias("label"), F.col("component").alias("further"))
        moved = near.join(of_label, "label", "left").select("id", "old", F.least("label", "further").alias("component"))
        moved = materialise(moved, "labels")
        labels = moved.drop("old")
        if moved.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")
