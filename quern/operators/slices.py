"""Time slices of keys that hold too many rows for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import ready

#: Slices that one key is cut into at most.
MOST = 1024


def bounds(rows: DataFrame, on: list[str], at: str, limit: int) -> DataFrame | None:
    """(*on, bounds): for each key with more than `limit` rows the times that cut it into slices of about that many; None if there is no such key.

    Counts and quantiles are combined before they are shuffled, and only frequent keys
    get quantiles, so there is at most one row for each `limit` rows. It is checkpointed.
    """
    ready(rows.sparkSession)
    often = rows.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > limit).checkpoint()
    if often.isEmpty():
        return None
    parts = [F.lit(i / MOST) for i in range(1, MOST)]
    cut = rows.select(*on, at).join(F.broadcast(often) if often.count() <= MOST else often, on).groupBy(*on, "n").agg(F.approx_percentile(at, F.array(*parts), F.lit(10 * MOST)).alias("all"))
    # every k-th quantile makes as many slices as the count asks for
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST) * limit / F.col("n")).cast("int"))
    chosen = F.filter("all", lambda x, i: (i + 1) % step == 0)
    return cut.select(*on, F.array_sort(F.array_distinct(chosen)).alias("bounds")).checkpoint()


def slice_of(at: Column, cuts: Column) -> Column:
    """Number of the slice, from 0, that a time lies in: how many of the sorted cuts are before it, bisected. Rows of one time share a slice. 0 where `cuts` is null."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((MOST - 1).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) < at, n + step).otherwise(n))
