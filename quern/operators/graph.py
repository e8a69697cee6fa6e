"""Edge lists from relational tables, and walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import ready


def transition_edges(events: DataFrame, actor: str, state: str, order: list[str | Column]) -> DataFrame:
    """(src, dst, weight): how often an actor's `state` is followed by which next one.

    One shuffle by actor; the counts are combined before the second. Rows with a null
    actor are left out, a null state is a state of its own.
    """
    by_actor = Window.partitionBy(actor).orderBy(*order)
    steps = events.where(F.col(actor).isNotNull()).select(
        F.col(state).alias("src"),
        F.lead(state).over(by_actor).alias("dst"),
        F.lead(F.lit(True)).over(by_actor).alias("follows"),
    )
    return steps.where("follows").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def bipartite_degrees(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(side, node, degree): distinct neighbours of each end of the bipartite graph of two columns."""
    edges = rows.select(F.col(left).alias("l"), F.col(right).alias("r")).dropna().distinct()
    outs = edges.groupBy("l").agg(F.count("*").alias("degree")).select(F.lit("left").alias("side"), F.col("l").alias("node"), "degree")
    ins = edges.groupBy("r").agg(F.count("*").alias("degree")).select(F.lit("right").alias("side"), F.col("r").alias("node"), "degree")
    return outs.unionByName(ins)


def k_hop(edges: DataFrame, src: str, dst: str, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, depth): nodes within `hops` directed edges of each start, with their least depth.

    starts: one column of nodes. Each hop is one join of the frontier with the edges
    and one anti-join with what was reached before; the frontier is checkpointed.
    """
    ready(edges.sparkSession)
    step = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).dropna().distinct()
    first = starts.select(F.col(starts.columns[0]).alias("start")).dropna().distinct()
    reached = first.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = reached
    for depth in range(1, hops + 1):
        frontier = frontier.join(step, F.col("node") == F.col("s")).select("start", F.col("d").alias("node")).distinct()
        frontier = frontier.join(reached, ["start", "node"], "left_anti").select("start", "node", F.lit(depth).alias("depth")).checkpoint()
        reached = reached.unionByName(frontier)
    return reached
