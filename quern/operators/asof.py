"""As-of joins: each row with the last row before it of one or more other streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import sent_if_small
from .slices import bounds, slice_of

#: Rows of one key that are sorted together.
LIMIT = 1 << 21


@dataclass(frozen=True)
class Stream:
    """What is looked up: `keep` of the last of `rows`. Of rows with one key and time the one with the largest `ties` counts, nulls being smallest."""

    name: str
    rows: DataFrame
    on: list[str]
    at: str
    keep: list[str]
    ties: list[str] = field(default_factory=list)


def merged(left: DataFrame, on: list[str], at: str, streams: list[Stream], strict: bool) -> tuple[DataFrame, list[str], list[Column]]:
    """(rows, keys, order): all rows that can meet, under common keys and one time, and their order within a key."""
    keys = [f"__k{i}" for i in range(len(on))]

    def shaped(rows: DataFrame, names: list[str], time: str, own: bool, *more: Column) -> DataFrame:
        # at equal times the rows that look things up come first if only earlier ones count, else last
        side = F.lit(own != strict).alias("__side")
        return rows.select(*(F.col(c).alias(k) for c, k in zip(names, keys, strict=True)), F.col(time).alias("__at"), side, F.lit(own).alias("__own"), *more)

    rows = shaped(left, on, at, True, F.struct(*(F.col(c) for c in left.columns)).alias("__row"))
    for i, s in enumerate(streams):
        tie = F.struct(*(F.col(c) for c in s.ties)) if s.ties else F.struct(F.lit(0))
        held = F.struct(*(F.col(c) for c in s.keep)) if s.keep else F.struct(F.lit(True).alias("found"))
        rows = rows.unionByName(shaped(s.rows, s.on, s.at, False, held.alias(f"__s{i}"), tie.alias(f"__t{i}")), allowMissingColumns=True)
    whole = F.col("__at").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return rows.where(whole), keys, [F.col("__at"), F.col("__side"), *(F.col(f"__t{i}").asc_nulls_first() for i in range(len(streams)))]


def as_of(left: DataFrame, on: list[str], at: str, streams: list[Stream], strict: bool = True, limit: int = LIMIT) -> DataFrame:
    """`left` with a struct for each stream: its last row of the same key before the row's time (`strict`), or at it too; null if there is none.

    All streams and `left` are one tagged union, which is shuffled once by key; the last
    values are carried forward there. A key with more than `limit` rows is cut into time
    slices. The last row of each slice of the streams, found with a partial aggregate, is
    handed to the slices after it. Rows of `left` with a null key or time are kept
    without a match, such rows of a stream match nothing. Repeated rows are kept. Times
    are numbers, dates or timestamps.
    """
    rows, keys, order = merged(left, on, at, streams, strict)
    values = [f"__s{i}" for i in range(len(streams))]
    cuts = bounds(rows, keys, "__at", limit)
    sliced = rows.withColumn("__slice", F.lit(0)) if cuts is None else rows.join(sent_if_small(cuts), keys, "left").withColumn("__slice", slice_of(F.col("__at"), F.col("bounds")))
    running = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = sliced.select(*keys, "__slice", "__own", "__row", *(F.last(v, ignorenulls=True).over(running).alias(v) for v in values)).where("__own")
    if cuts is not None:
        lasts = sliced.where("not __own and bounds is not null").groupBy(*keys, "__slice")
        lasts = lasts.agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct("__at", f"__t{i}"))).alias(v) for i, v in enumerate(values)))
        every = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("__slice")).join(lasts, [*keys, "__slice"], "left")
        before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        handed = every.select(*keys, "__slice", *(F.last(v, ignorenulls=True).over(before).alias(f"__h{v}") for v in values)).checkpoint()
        filled = filled.join(sent_if_small(handed), [*keys, "__slice"], "left").withColumns({v: F.coalesce(F.col(v), F.col(f"__h{v}")) for v in values})
    matched = filled.select("__row.*", *(F.col(v).alias(s.name) for v, s in zip(values, streams, strict=True)))
    lacking = F.col(at).isNull()
    for c in on:
        lacking = lacking | F.col(c).isNull()
    return matched.unionByName(left.where(lacking), allowMissingColumns=True)
