"""Connected components of an edge table, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of its component, for every node with an edge.

    Alternates min-label exchange along edges with pointer jumping, so rounds grow with the logarithm of the longest
    chain. Each round is a table in the shared folder; the driver sees one count per round.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = _base.materialize(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    label = _base.materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    kept = label
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("label").alias("_l")), "other")
        best = near.groupBy("node").agg(F.min("_l").alias("_m"))
        step = label.join(best, "node").select("node", F.least("label", "_m").alias("_step"), F.col("label").alias("_old"))
        # jump: take the label of the label, where that node has one
        jump = label.select(F.col("node").alias("_step"), F.col("label").alias("_j"))
        moved = step.join(jump, "_step", "left").select("node", F.least("_step", F.coalesce("_j", "_step")).alias("label"), "_old")
        moved = _base.materialize(moved, "labels")
        _base.discard(kept)
        if moved.filter("label <> _old").limit(1).count() == 0:
            _base.discard(both)
            return moved.select("node", F.col("label").alias("component"))
        kept, label = moved, moved.select("node", "label")
