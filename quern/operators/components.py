"""Connected components of an edge list by hash-to-min star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import ready


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each end of an edge; component is the smallest node that edges reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each node's
    larger neighbours, then its smaller ones, are hung on the smallest node around
    it, until two rounds have exactly the same edges. Both steps are one shuffle with a
    running minimum, so a hub needs no group in memory. Edges with a null end or equal
    ends only add their nodes. Each round is cut from its lineage by checkpoint(); the
    session's checkpoint folder has to be shared by all executors.
    """
    ready(edges.sparkSession)
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()
    now = ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = now.checkpoint()
    n, settled = now.count(), False
    for _ in range(max_rounds):
        if settled or not n:
            break
        # large star: u's larger neighbours, hung on the least of u and its neighbours
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours, hung on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        before, now = now, small.checkpoint()
        # edges are distinct: as many as before, and none that was not there
        last, n = n, now.count()
        settled = n == last and now.join(before, ["u", "v"], "left_anti").isEmpty()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("component")), nodes["node"] == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
