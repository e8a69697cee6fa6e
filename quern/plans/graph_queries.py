"""Graph-building queries over the test tables, with their SQL.

They stand for no feature of another system: the material to match has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.operators.graph import bipartite_degrees, k_hop, transition_edges
from quern.operators.projection import shared_groups
from quern.streaming.edges import windowed_edges


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transition_edges(_table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def supplier_part_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite_degrees(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


def nation_trade_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the suppliers of their own nation from whom they bought: components of both, customers by key, suppliers by -1 - key."""
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    bought = _table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    home = bought.join(_table(spark, sf_dir, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    edges = home.select(F.col("c_custkey").alias("u"), (-1 - F.col("s_suppkey")).alias("v")).distinct()
    return connected_components(edges, "u", "v")


def customer_order_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within two steps of each customer: customer to order, order to part."""
    orders = _table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("s"), F.concat(F.lit("o"), "o_orderkey").alias("d"))
    lines = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("d"))
    starts = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return k_hop(orders.union(lines), "s", "d", starts, 2)


def daily_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming edge counts."""
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_edges(events, "ts", "user_id", "event_type", "1 day", "1 day").select(F.date_format("begin", "yyyy-MM-dd").alias("begin"), "src", "dst", "weight")


def part_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were ordered together, and in how many orders."""
    return shared_groups(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (event_transitions, supplier_part_degrees, nation_trade_components, customer_order_hops, daily_user_events, part_order_edges)}


def oracle_sql() -> dict[str, str]:
    return {
        "part_order_edges": """
            WITH e AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL)
            SELECT x.n AS a, y.n AS b, count(*) AS weight FROM e AS x JOIN e AS y ON x.g = y.g AND x.n < y.n GROUP BY ALL""",
        "daily_user_events": """
            SELECT strftime(ts, '%Y-%m-%d') AS begin, user_id AS src, event_type AS dst, count(*) AS weight
            FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL""",
        "event_transitions": """
            SELECT src, dst, count(*) AS weight FROM (
                SELECT event_type AS src,
                       lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst,
                       lead(true) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS follows
                FROM events WHERE user_id IS NOT NULL)
            WHERE follows GROUP BY src, dst""",
        "supplier_part_degrees": """
            WITH edges AS (SELECT DISTINCT l_suppkey AS l, l_partkey AS r FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL)
            SELECT 'left' AS side, l AS node, count(*) AS degree FROM edges GROUP BY l
            UNION ALL SELECT 'right', r, count(*) FROM edges GROUP BY r""",
        "nation_trade_components": """
            WITH RECURSIVE e AS (
                SELECT DISTINCT c_custkey AS u, -1 - s_suppkey AS v
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey),
            both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
            reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT reach.node, v FROM reach JOIN both_ways ON other = u)
            SELECT node, min(other) AS component FROM reach GROUP BY node""",
        "customer_order_hops": """
            WITH starts AS (SELECT c_custkey FROM customer),
            o AS (SELECT c_custkey, o_orderkey FROM starts JOIN orders ON o_custkey = c_custkey)
            SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS depth FROM starts
            UNION ALL SELECT 'c' || c_custkey, 'o' || o_orderkey, 1 FROM o
            UNION ALL SELECT DISTINCT 'c' || c_custkey, 'p' || l_partkey, 2 FROM o JOIN lineitem ON l_orderkey = o_orderkey""",
    }
