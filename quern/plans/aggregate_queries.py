"""Queries with grouping sets, snapshots and JSON properties, with their SQL. They stand for no feature of another system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.cubes import cube, grouped_distinct
from quern.operators.parts import joined
from quern.operators.snapshots import difference
from quern.sources.properties import property_edges


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, distinct parts and cents by every choice of customer's nation, segment and order priority."""
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = _table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    n_orders = orders.count()
    orders = joined(orders, customers, ("o_custkey", "c_custkey"), n_orders)
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    dimensions = ["n_name", "c_mktsegment", "o_orderpriority"]
    n_lines = lines.count()
    bought = joined(lines, orders, ("l_orderkey", "o_orderkey"), n_lines + n_orders)
    return grouped_distinct(bought, dimensions, cube(dimensions), "l_partkey", ["cents"], n_lines).withColumn("level", F.col("level").cast("long"))


def trade_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the edges of customers and suppliers, by return flag, changed from lines shipped in 1996 to those of 1997."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year")).where("year in (1996, 1997)")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_returnflag", "year")
    of = lambda y: edges.where(F.col("year") == y).drop("year")
    return difference(of(1996), of(1997), ["o_custkey", "l_suppkey"])


def user_property_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between users and the values of their events' properties."""
    return property_edges(_table(spark, sf_dir, "events"), "user_id", "props")[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (market_cube, trade_changes, user_property_edges)}


def oracle_sql() -> dict[str, str]:
    return {
        "market_cube": """
            SELECT n_name, c_mktsegment, o_orderpriority, GROUPING(n_name, c_mktsegment, o_orderpriority)::BIGINT AS level, count(*) AS n, count(DISTINCT l_partkey) AS n_distinct, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            GROUP BY CUBE (n_name, c_mktsegment, o_orderpriority)""",
        "trade_changes": """
            WITH e AS (SELECT o_custkey, l_suppkey, l_returnflag, year(l_shipdate) AS y, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) IN (1996, 1997) GROUP BY ALL),
            d AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(b.k, 0) - coalesce(a.k, 0) AS n
                  FROM (FROM e WHERE y = 1996) AS a FULL OUTER JOIN (FROM e WHERE y = 1997) AS b
                  ON a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.l_suppkey IS NOT DISTINCT FROM b.l_suppkey AND a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag
                  WHERE coalesce(a.k, 0) <> coalesce(b.k, 0))
            SELECT o_custkey, l_suppkey, l_returnflag, n::BIGINT AS n,
                   CASE WHEN max(n) OVER w > 0 AND min(n) OVER w < 0 THEN 'change' WHEN max(n) OVER w > 0 THEN 'insert' ELSE 'delete' END AS kind
            FROM d WINDOW w AS (PARTITION BY o_custkey, l_suppkey)""",
        "user_property_edges": """
            SELECT user_id AS node, key AS path, CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' ELSE lower(type) END AS kind, json_extract_string(props, '$.' || key) AS value, count(*) AS weight
            FROM (SELECT user_id, props, unnest(json_keys(props)) AS key FROM events WHERE user_id IS NOT NULL), LATERAL (SELECT json_type(props, '$.' || key) AS type) GROUP BY ALL""",
    }
