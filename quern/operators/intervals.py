"""Range joins: pairs of rows whose intervals overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import sent_if_small
from .parts import parts
from .slices import bounds, slice_of

#: Starts in a bin, and rows of one side in a tile, about.
LIMIT = 1 << 17


def _laid(rows: DataFrame, on: list[str], span: tuple[str, str], cuts: DataFrame | None, side: str) -> DataFrame:
    """A copy of each row for each bin that its interval reaches: `side`_k0.., `side`_row, `side`_start, `side`_end, `side`_first, bin."""
    start, end = span
    usable = F.col(start) <= F.col(end)
    for c in on:
        usable = usable & F.col(c).isNotNull()
    keys = [f"__k{i}" for i in range(len(on) or 1)]
    # without a key, one that Catalyst doesn't take for a constant: a join on a constant has no keys and would loop
    named = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)] if on else [F.col(start).isNull().alias(keys[0])]
    laid = rows.where(usable).select(*named, F.struct(*(F.col(c) for c in rows.columns)).alias(f"{side}_row"), F.col(start).alias(f"{side}_start"), F.col(end).alias(f"{side}_end"))
    if cuts is None:
        return laid.withColumn(f"{side}_first", F.lit(0)).withColumn("bin", F.lit(0))
    laid = laid.join(sent_if_small(cuts), keys, "left")
    first, last = slice_of(F.col(f"{side}_start"), F.col("bounds")), slice_of(F.col(f"{side}_end"), F.col("bounds"))
    return laid.withColumn(f"{side}_first", first).withColumn("bin", F.explode(F.sequence(first, last))).drop("bounds")


def _tiled(rows: DataFrame, loads: DataFrame, keys: list[str], side: str, own: str, other: str) -> DataFrame:
    """Each row in one of its side's parts of a crowded bin, copied for every part of the other side. Which part, the row itself decides, so a task that runs again deals alike."""
    placed = rows.join(loads, [*keys, "bin"], "left").withColumns({own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))})
    part = F.pmod(F.xxhash64(f"{side}_row"), F.col(own)).cast("int")
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).withColumn(own, part)


def overlapping(left: DataFrame, right: DataFrame, on: tuple[list[str], list[str]], spans: tuple[tuple[str, str], tuple[str, str]], limit: int = LIMIT, where: Column | None = None, size: int | None = None) -> DataFrame:
    """(left, right): structs of all pairs of rows with equal keys (`on` may be two empty lists) whose intervals, ends included, have a moment in common, and for which `where` holds.

    The times of a key with more than `limit` starts are cut into bins of about that
    many, and a row is laid into each bin that it reaches. Two rows may meet in several
    bins; they are a pair in the bin where the later of them starts alone, so nothing is
    made twice and no distinct is needed. A bin that long intervals crowd is cut into
    tiles: parts of both sides by count. Rows with a null key, a null end or an end
    before their start take no part. Repeated rows pair each time. Rows are dealt to
    partitions of bounded size, however many there are. size: how many rows both sides
    have, about, if that is known; else they are counted, which is a pass over them.
    """
    spark, size = left.sparkSession, left.count() + right.count() if size is None else size
    keys = [f"__k{i}" for i in range(len(on[0]) or 1)]
    plain = [_laid(rows, names, span, None, side).select(*keys, F.col(f"{side}_start").alias("at")) for rows, names, span, side in ((left, on[0], spans[0], "left"), (right, on[1], spans[1], "right"))]
    cuts = bounds(plain[0].unionByName(plain[1]), keys, "at", limit)
    a, b = _laid(left, on[0], spans[0], cuts, "left"), _laid(right, on[1], spans[1], cuts, "right")
    places = keys
    if cuts is not None:
        places = [*keys, "bin"]
        met = a.select(*places, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*places, F.lit(0).alias("l"), F.lit(1).alias("r")))
        counted = met.groupBy(*places).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).withColumns({"i": F.ceil(F.col("l") / limit).cast("int"), "j": F.ceil(F.col("r") / limit).cast("int")}).checkpoint()
        loads = counted.where("i > 0 and j > 0 and i + j > 2").select(*places, "i", "j")
        # with a copy of a row for each bin, and for each tile of a crowded one
        size = counted.agg(F.coalesce(F.sum(F.expr("l * greatest(j, 1) + r * greatest(i, 1)")), F.lit(0))).first()[0]
        a, b = _tiled(a, sent_if_small(loads), keys, "left", "i", "j"), _tiled(b, sent_if_small(loads), keys, "right", "j", "i")
        places = [*places, "i", "j"]
    pair = (F.col("left_start") <= F.col("right_end")) & (F.col("right_start") <= F.col("left_end"))
    if cuts is not None:
        pair = pair & (F.col("bin") == F.greatest("left_first", "right_first"))
    n = parts(spark, size)
    joined = a.repartition(n, *places).join(b.repartition(n, *places), places).where(pair).select(F.col("left_row").alias("left"), F.col("right_row").alias("right"))
    return joined if where is None else joined.where(where)
