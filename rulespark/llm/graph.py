"""Connected components by label propagation with pointer jumping; every round is a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import dropped, staged


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node of ``edges`` (a, b long; any direction, loops and
    repeats allowed). No edges: no rows."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "edges")
    lab = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        met = both.join(lab.select(F.col("node").alias("b"), "root"), "b")
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = lab.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        low = staged(low, "low")
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = staged(low.join(jump, "root").select("node", "old", F.col("far").alias("root")), "labels")
        moved = new.where("old <> root").limit(1).count()
        dropped(lab)
        dropped(low)
        lab = new
        if not moved:
            dropped(both)
            return lab.select("node", "root")
