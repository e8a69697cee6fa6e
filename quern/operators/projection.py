"""One-mode projections of bipartite edges: which nodes have groups in common, and how many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import ready, sent_if_small
from .parts import parts

#: Members of a group that are paired with as many others in one task, about.
LIMIT = 1 << 12
#: Pairs that a task makes or adds up, about; a tile of large parts makes up to LIMIT ** 2.
PAIRS = 1 << 19


def shared_groups(edges: DataFrame, group: str, node: str, least: int = 1, limit: int = LIMIT) -> DataFrame:
    """(a, b, weight): pairs of nodes, a < b, and the number of groups that both are in, if that is `least` or more.

    A node is in a group once, however often the edge is repeated; edges with a null are
    left out. A group of m members makes m (m - 1) / 2 pairs, which is the result itself
    where nothing repeats, so `least` and the counts are all that can shrink it; but no
    group is one task. The members of a large one are dealt into parts by hash, and each
    pair of parts is a tile of its own. Edges and pairs are counted first, and dealt in
    partitions of bounded size, however many there are. Where there are more pairs than
    any two nodes can make, so that they must repeat, weights are combined before they
    are shuffled.
    """
    spark = edges.sparkSession
    ready(spark)
    members = edges.select(F.col(group).alias("g"), F.col(node).alias("n")).dropna().repartition(parts(spark, edges.count()), "g", "n").distinct().checkpoint()
    size = F.col("size").cast("double")
    n_members, n_pairs = members.groupBy("g").agg(F.count("*").alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0))).first()
    nodes = members.agg(F.approx_count_distinct("n")).first()[0]
    n_pairs = int(n_pairs)
    large = members.groupBy("g").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts")).where("parts > 1").checkpoint()
    if large.isEmpty():
        placed, on = members.withColumns({"part": F.lit(0), "parts": F.lit(1)}), ["g"]
    else:
        on = ["g", "low", "high"]
        placed = members.join(sent_if_small(large), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int"))
    # a tile is named by its lower and its upper part: a member is in the rows of its own part on the left, in those up to it on the right
    left = placed.select("g", F.col("n").alias("x"), F.col("part").alias("low"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("high"))
    right = placed.select("g", F.col("n").alias("y"), F.col("part").alias("high"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("low"))
    # a member of a large group is copied for its tiles, which make far more pairs than there are copies
    tiles = max(parts(spark, 2 * n_members), parts(spark, n_pairs, PAIRS))
    # without large groups low and high are one constant
    other = (F.col("low") < F.col("high")) | (F.col("x") < F.col("y")) if len(on) > 1 else F.col("x") < F.col("y")
    met = left.repartition(tiles, *on).join(right.repartition(tiles, *on), on).where(other)
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if n_pairs <= nodes * (nodes - 1) / 2:
        pairs = pairs.repartition(parts(spark, n_pairs, PAIRS), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
