"""Cheapest walks over a weighted edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import ready, sent_if_small

#: Edges of one node that a task relaxes together, about.
HUB = 1 << 18


def cheapest_walks(edges: DataFrame, src: str, dst: str, cost: str, starts: DataFrame, max_rounds: int = 1000, hub: int = HUB) -> DataFrame:
    """(start, node, cost): the least sum of edge costs from each start (one column of nodes) to each node that it reaches; 0 to itself.

    Rounds of relaxation: only nodes whose cost fell in the last round (the frontier)
    walk their edges, offers are combined to minima before they are shuffled, and an
    offer counts only if it beats what is known. It ends when no cost falls, which is an
    empty frontier, nothing else. The edges of a node with more than `hub` of them are
    dealt into parts by their other end, and the frontier's rows of such nodes are copied
    to these. Costs may be negative; a cycle that lowers costs without end, or walks of
    more than `max_rounds` edges, raise RuntimeError. Whole numbers stay whole. Rows with
    a null are left out, of repeated edges the cheapest counts. Each round is cut from
    its lineage by checkpoint().
    """
    ready(edges.sparkSession)
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("to"), F.col(cost).alias("step")).dropna()
    step = step.groupBy("node", "to").agg(F.min("step").alias("step")).checkpoint()
    hubs = step.groupBy("node").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts")).where("parts > 1").checkpoint()
    some = not hubs.isEmpty()
    hubs = sent_if_small(hubs)
    part = F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1))).cast("int")
    step = (step.join(hubs, "node", "left").withColumn("part", part).drop("parts") if some else step.withColumn("part", F.lit(0))).checkpoint()
    kind = step.schema["step"].dataType
    total = "long" if kind.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double" if kind.simpleString() in ("float", "double") else "decimal(38,%d)" % kind.scale
    first = starts.select(F.col(starts.columns[0]).alias("start")).dropna().distinct()
    known = first.select("start", F.col("start").alias("node"), F.lit(0).cast(total).alias("cost")).checkpoint()
    frontier = known
    for _ in range(max_rounds):
        reach = frontier.join(hubs, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))) if some else frontier.withColumn("part", F.lit(0))
        offers = reach.join(step, ["node", "part"]).groupBy("start", F.col("to").alias("node")).agg(F.min((F.col("cost") + F.col("step")).cast(total)).alias("offer"))
        merged = known.join(offers, ["start", "node"], "full_outer")
        better = F.col("offer").isNotNull() & (F.col("cost").isNull() | (F.col("offer") < F.col("cost")))
        merged = merged.select("start", "node", F.when(better, F.col("offer")).otherwise(F.col("cost")).alias("cost"), better.alias("fell")).checkpoint()
        known, frontier = merged.select("start", "node", "cost"), merged.where("fell").select("start", "node", "cost")
        if frontier.isEmpty():
            return known
    raise RuntimeError(f"costs still fell after {max_rounds} rounds")
