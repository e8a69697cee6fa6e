"""Shuffles with as many partitions as their rows need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task sorts or keeps in a hash table at once, about.
ROWS = 1 << 18
#: Tables of fewer rows in a task are not worth as many tasks as the session asks for.
LEAST = 1 << 14


def parts(spark: SparkSession, rows: int, limit: int | None = None) -> int:
    """How many partitions hold `limit` (ROWS) of `rows` rows each: what spark.sql.shuffle.partitions says, if that is enough, and fewer for a small table.

    With that setting alone, which does not know the table, a task's memory grows with it.
    """
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // (limit or ROWS)), min(asked, -(-rows // LEAST)))


def joined(left: DataFrame, right: DataFrame, on: tuple[str, str], rows: int) -> DataFrame:
    """The inner join by one column of each, of tables that have `rows` rows in all."""
    n = parts(left.sparkSession, rows)
    return left.repartition(n, on[0]).join(right.repartition(n, on[1]), F.col(on[0]) == F.col(on[1]))
