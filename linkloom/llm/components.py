"""Connected components of an edge table by repeated minimum labels with pointer jumping; every round is a table in
the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges: (a, b). Returns (node, comp) for the nodes of edges, comp being the smallest node of the component.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label, so
    the rounds grow as the logarithm of the diameter in practice. Aggregates are partial before they shuffle, so a node
    with very many neighbours is no hot key; joins on it are split by adaptive execution. No edges: no rows."""
    both = scratch.save(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("jumped"))
        step = scratch.save(nearer.join(jump, "to", "left").select("node", F.least("to", "jumped").alias("comp"), "was"))
        changed = not step.where("comp <> was").isEmpty()
        scratch.drop(labels)
        labels = step.select("node", "comp")
        labels._linkloom_path = step._linkloom_path
        if not changed:
            scratch.drop(both)
            return labels
