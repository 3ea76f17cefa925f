"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that each end of an edge can reach.

    Every round takes the smallest root among the neighbours and then the root of that root, so that long chains halve.
    Rounds are written to the shared folder; only the number of changes comes to the driver. Hot nodes meet in minimum
    aggregates, which are combined before the shuffle.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).filter("node <> near")
    both = cut_lineage(pairs.union(pairs.select("near", "node")).distinct(), "edges")
    roots = cut_lineage(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")), "roots")
    while True:
        offered = both.join(roots.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("root").alias("offer"))
        lowered = roots.join(offered, "node").select("node", F.least("root", "offer").alias("best"), F.col("root").alias("was"))
        lowered = cut_lineage(lowered, "lowered")
        jump = lowered.select(F.col("node").alias("best"), F.col("best").alias("beyond"))
        roots = cut_lineage(
            lowered.join(jump, "best", "left").select("node", F.least("best", "beyond").alias("root"), "was"), "roots")
        if not roots.filter("root <> was").limit(1).count():
            return roots.select("node", "root")
