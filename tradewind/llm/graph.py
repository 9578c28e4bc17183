"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import drop, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (node, root): root is the smallest node of node's component.

    Every round is two grouped minima and two joins, so no node's neighbours meet in one task
    (the minima are partially aggregated, and adaptive skew joins split a hot node). Each round is
    written to the shared folder; the loop ends when the edge set no longer changes, after a number
    of rounds that is logarithmic in the size of the largest component. Loops and repeated edges
    are ignored; no edges give no rows.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        after = materialize(small.distinct(), "edges")
        drop(now)
        now = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
