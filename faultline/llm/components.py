"""Connected components of a distributed edge table: contraction towards least nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label): ``label`` is the least node of the node's component; nodes are those of ``edges`` (a, b long) that
    have an edge to another one.

    Each round every node points to its least neighbour if that is smaller, two jumps follow the pointers, and the graph
    is contracted: of two rounds at least one halves the nodes, and edges within what was put together are gone.  Each round
    is written to the shared folder; hot nodes are combined before the shuffle.  No edges give no rows; nulls, loops and
    repeated edges are harmless.
    """
    between = lambda e: e.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, labels = materialize(between(edges), "edges"), None
    while labels is None or left.limit(1).count():
        both = left.select("a", "b").union(left.select("b", "a"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        to = materialize(to, "pointers")
        for _ in range(2):
            further = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = to.join(further, "to").select("node", F.col("next").alias("to"))
        to = materialize(to, "pointers")
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = materialize(between(left.join(a, "a").join(b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
        if labels is None:
            labels = to.select("node", F.col("to").alias("label"))
        else:
            last = to.select(F.col("node").alias("label"), "to")
            labels = materialize(labels.join(last, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    return labels
