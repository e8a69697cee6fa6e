"""Queries over time, intervals and walks, with their SQL. They stand for no feature of another system."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.asof import Stream, as_of
from quern.operators.intervals import overlapping
from quern.operators.parts import joined, parts
from quern.operators.walks import cheapest_walks
from quern.streaming.paths import paths
from quern.streaming.sessions import sessions, sliding_edges

#: A user's path ends where nothing follows for so long; a session, too.
PATH_GAP, SESSION_GAP = datetime.timedelta(hours=12), "6 hours"
#: Days that a shipment is on its way.
TRANSIT = 14


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a time that streams can have a watermark on."""
    return _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _moment(at: Column | str) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def purchase_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's last view, and last order, before it."""
    events = _table(spark, sf_dir, "events")
    views = Stream("view", events.where("event_type = 'view'"), ["user_id"], "ts", ["event_id", "value"], ["event_id"])
    orders = Stream("order", _table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"], ["o_orderkey"])
    found = as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), ["user_id"], "ts", [views, orders])
    return found.select("event_id", "user_id", F.col("view.event_id").alias("view_id"), F.col("view.value").alias("view_value"), F.col("order.o_orderkey").alias("order_id"))


def order_shipment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order and a shipment of another order of the same customer that was on its way while the first was open; an order is open until its last shipment, and never if that was before it."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    n_orders, n_lines = orders.count(), lines.count()
    last = lines.repartition(parts(spark, n_orders + n_lines), "l_orderkey").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    spans = joined(orders, last, ("o_orderkey", "l_orderkey"), n_orders + n_lines).drop("l_orderkey")
    shipped = joined(lines, orders, ("l_orderkey", "o_orderkey"), n_orders + n_lines).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_shipdate") + F.expr(f"interval {TRANSIT} days")).alias("arrives"))
    pairs = overlapping(spans, shipped, (["o_custkey"], ["o_custkey"]), (("o_orderdate", "closed"), ("l_shipdate", "arrives")), where=F.col("left.o_orderkey") != F.col("right.l_orderkey"), size=n_orders + n_lines)
    days = F.datediff(F.least("left.closed", "right.arrives"), F.greatest("left.o_orderdate", "right.l_shipdate"))
    return pairs.select("left.o_custkey", "left.o_orderkey", "right.l_orderkey", "right.l_linenumber", "right.l_partkey", "right.l_suppkey", days.cast("long").alias("days"))


def user_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the paths of a stream: runs of a user's events that end with a purchase or by a gap."""
    found = paths(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", ["purchase"], PATH_GAP)
    return found.select("who", _moment("begin").alias("begin"), _moment("end").alias("end"), F.array_join("steps", ">").alias("steps"), "ended")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of merging windows, with the graph that each session walked."""
    found = sessions(_events(spark, sf_dir), "ts", "user_id", "event_type", SESSION_GAP, "1 day")
    edges = F.array_join(F.array_sort(F.transform(F.map_entries("edges"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return found.select("who", _moment("begin").alias("begin"), _moment("end").alias("end"), "n", edges.alias("edges"))


def weekly_user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of overlapping windows: edges of users and event types in each seven days."""
    found = sliding_edges(_events(spark, sf_dir), "ts", "user_id", "event_type", "7 days", "1 day", "1 day")
    return found.select(F.date_format("begin", "yyyy-MM-dd").alias("begin"), "src", "dst", "weight")


def nation_cheapest_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest walks over the trade graph, from the nation of each customer: an edge from buyer's to seller's nation costs the cents of the cheapest line between them."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    bought = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    sold = lines.join(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    edges = bought.join(sold, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("c_nationkey", "s_nationkey").agg(F.min(cents).alias("cents"))
    return cheapest_walks(edges, "c_nationkey", "s_nationkey", "cents", customers.select("c_nationkey").distinct())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (purchase_contexts, order_shipment_overlaps, user_paths, user_sessions, weekly_user_edges, nation_cheapest_walks)}


def oracle_sql() -> dict[str, str]:
    return {
        "purchase_contexts": """
            WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
            v AS (SELECT user_id, ts, max(event_id) AS view_id, max_by(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY user_id, ts),
            o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS order_id FROM orders GROUP BY o_custkey, o_orderdate)
            SELECT p.event_id, p.user_id, view_id, view_value, order_id
            FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts ASOF LEFT JOIN o ON p.user_id = o.o_custkey AND p.ts > o.o_orderdate""",
        "order_shipment_overlaps": f"""
            WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, max(l_shipdate) AS closed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING o_orderdate <= max(l_shipdate)),
            t AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_shipdate + INTERVAL {TRANSIT} DAY AS arrives FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
            SELECT s.o_custkey, o_orderkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, datediff('day', greatest(o_orderdate, l_shipdate), least(closed, arrives))::BIGINT AS days
            FROM s JOIN t ON s.o_custkey = t.o_custkey AND o_orderdate <= arrives AND l_shipdate <= closed AND o_orderkey <> l_orderkey""",
        "user_paths": """
            WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS last, ts - lag(ts) OVER w AS gap FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            n AS (SELECT *, sum(CASE WHEN last IS NULL OR last = 'purchase' OR gap > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS path FROM e)
            SELECT user_id AS who, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS "begin", strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS "end",
                   string_agg(event_type, '>' ORDER BY ts, event_id) AS steps, CASE WHEN bool_or(event_type = 'purchase') THEN 'state' ELSE 'gap' END AS ended
            FROM n GROUP BY user_id, path""",
        "user_sessions": """
            WITH e AS (SELECT user_id, ts, event_type, ts - lag(ts) OVER w AS gap FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
            n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS session FROM e),
            s AS (SELECT user_id, session, min(ts) AS b, max(ts) + INTERVAL 6 HOUR AS f, count(*) AS n FROM n GROUP BY ALL),
            steps AS (SELECT user_id, session, event_type || '>' || lead(event_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_type) AS edge FROM n),
            edges AS (SELECT user_id, session, string_agg(edge || ':' || k, ',' ORDER BY edge || ':' || k) AS edges FROM (SELECT user_id, session, edge, count(*) AS k FROM steps WHERE edge IS NOT NULL GROUP BY ALL) GROUP BY ALL)
            SELECT s.user_id AS who, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS "begin", strftime(f, '%Y-%m-%d %H:%M:%S.%f') AS "end", n, coalesce(edges, '') AS edges
            FROM s LEFT JOIN edges ON s.user_id = edges.user_id AND s.session = edges.session""",
        "weekly_user_edges": """
            SELECT strftime(day - i * INTERVAL 1 DAY, '%Y-%m-%d') AS begin, user_id AS src, event_type AS dst, count(*) AS weight
            FROM (SELECT date_trunc('day', ts) AS day, user_id, event_type FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL), range(7) AS s(i) GROUP BY ALL""",
        "nation_cheapest_walks": """
            WITH RECURSIVE e AS (
                SELECT c_nationkey AS u, s_nationkey AS v, min(round(l_extendedprice * 100)::BIGINT) AS cents
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
            walks AS (
                SELECT DISTINCT 0 AS steps, c_nationkey AS start, c_nationkey AS node, 0::BIGINT AS cost FROM customer
                UNION ALL SELECT steps + 1, start, v, min(cost + cents) FROM walks JOIN e ON node = u WHERE steps < 25 GROUP BY steps, start, v)
            SELECT start, node, min(cost)::BIGINT AS cost FROM walks GROUP BY start, node""",
    }
