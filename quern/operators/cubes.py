"""Grouping sets with exact distinct counts from one expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import parts

#: Copies of rows that a task keeps in a hash table at once, about.
COPIES = 1 << 20


def grouped_distinct(rows: DataFrame, dimensions: list[str], levels: list[list[str]], distinct: str, sums: list[str], size: int | None = None) -> DataFrame:
    """(*dimensions, level, n, n_distinct, *sums): a row for each group of each of the `levels`, which are lists of dimensions.

    level has a bit for each dimension that the level leaves out, the last dimension the
    lowest; such a dimension is null, as may be one with a null of its own. n counts rows, n_distinct
    the distinct values of `distinct` that aren't null, sums add up their columns.

    Rows are dealt by value, in partitions of about COPIES copies each, however many
    rows there are, and combined to one for each combination of dimensions and
    `distinct`. A value that stands in many rows is dealt over several tasks, and met by
    one only when it is combined. As all rows of a value lie in one partition then, their
    copies for each level are combined by level and value where they are made, and only
    counts are shuffled after that. So the table is read once, no level has a job of its
    own, and no group needs a set in memory. size: how many rows there are, about, if
    that is known; else they are counted, which is a pass over them.
    """
    unknown = sorted({d for x in levels for d in x} - set(dimensions))
    if unknown:
        raise ValueError(f"not among the dimensions: {unknown}")
    held = {f"__s{i}": s for i, s in enumerate(sums)}
    sum_of = [F.sum(h).alias(h) for h in held]
    base = rows.select(*dimensions, F.col(distinct).alias("__value"), F.lit(1).cast("long").alias("__n"), *(F.col(s).alias(h) for h, s in held.items()))
    spark, size = rows.sparkSession, rows.count() if size is None else size
    # by the task that the row comes from, as a value may be that of half of the rows; any such number gives the same sums
    base = base.withColumn("__from", F.pmod(F.spark_partition_id(), F.lit(64))).repartition(parts(spark, size), "__value", "__from")
    base = base.groupBy(*dimensions, "__value", "__from").agg(F.sum("__n").alias("__n"), *sum_of)
    base = base.repartition(parts(spark, size * len(levels), COPIES), "__value").groupBy(*dimensions, "__value").agg(F.sum("__n").alias("__n"), *sum_of)
    number = lambda x: sum(1 << i for i, d in enumerate(reversed(dimensions)) if d not in x)
    kinds = dict(base.dtypes)
    shapes = [F.struct(F.lit(number(x)).alias("level"), *((F.col(d) if d in x else F.lit(None).cast(kinds[d])).alias(d) for d in dimensions)) for x in levels]
    expanded = base.select(F.explode(F.array(*shapes)).alias("g"), "__value", "__n", *held).select("g.*", "__value", "__n", *held)
    by_value = expanded.groupBy("level", *dimensions, "__value").agg(F.sum("__n").alias("__n"), *sum_of)
    return by_value.groupBy("level", *dimensions).agg(F.sum("__n").alias("n"), F.count("__value").alias("n_distinct"), *(F.sum(h).alias(s) for h, s in held.items())).select(*dimensions, "level", "n", "n_distinct", *sums)


def cube(dimensions: list[str]) -> list[list[str]]:
    """All lists of dimensions."""
    return [[d for i, d in enumerate(dimensions) if mask >> i & 1] for mask in range(1 << len(dimensions))]


def rollup(dimensions: list[str]) -> list[list[str]]:
    """All beginnings of the list of dimensions."""
    return [dimensions[:k] for k in range(len(dimensions) + 1)]
