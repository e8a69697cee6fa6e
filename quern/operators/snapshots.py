"""What changed between two snapshots of an edge list, repeated rows and nulls included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(columns of the snapshots, n, kind): each distinct row that `after` holds n times more often than `before`; n is below 0 for rows that went.

    kind is `insert` or `delete`, or `change` where rows of one key went and others came.
    Both snapshots are one union, counted with signs: equal rows cancel before and
    during the one shuffle of all rows, nulls being equal to each other. Only rows that
    differ are shuffled once more, by key. Applied to `before`, it gives `after`.
    """
    columns = before.columns
    if sorted(after.columns) != sorted(columns) or {"n", "kind"} & set(columns):
        raise ValueError("both snapshots need the same columns, none of them n or kind")
    both = before.withColumn("n", F.lit(-1).cast("long")).unionByName(after.withColumn("n", F.lit(1).cast("long")))
    differ = both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    of_key = Window.partitionBy(*key)
    came, went = F.max("n").over(of_key) > 0, F.min("n").over(of_key) < 0
    return differ.select(*columns, "n", F.when(came & went, "change").when(came, "insert").otherwise("delete").alias("kind"))


def applied(before: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot that the changes lead to, as a multiset. A change that takes more of a row than there are raises an error."""
    columns = before.columns
    both = before.withColumn("n", F.lit(1).cast("long")).unionByName(changes.select(*columns, "n"))
    counted = both.groupBy(*columns).agg(F.sum("n").alias("n"))
    left = F.when(F.col("n") < 0, F.raise_error(F.lit("more rows are taken than there are"))).otherwise(F.col("n"))
    # a row may be there very often: its copies are made where it lies, one at a time
    return counted.withColumn("n", left).where("n > 0").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*columns)
