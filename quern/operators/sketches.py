"""Approximate aggregates from mergeable sketches that are kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2 ** LOG registers of a distinct-count sketch: a standard error of about 1.04 / sqrt(2 ** LOG), 1.6 %.
LOG = 12
#: Size of a quantile sketch: its ranks are off by 1.4 % at most, 99 times in 100.
K = 200


def daily(events: DataFrame, ts: str, key: str, item: str, value: str) -> DataFrame:
    """(day, key, n, items, quantiles): of each day and key the count and two sketches, of distinct items and of values; rows without a time are left out."""
    return events.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"), F.col(key).alias("key")).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(item), F.lit(LOG)).alias("items"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("quantiles"),
    )


def add_days(sketches: DataFrame, folder: str) -> None:
    """Write the sketches as Parquet, a folder a day; days that are there already are replaced, others are neither read nor written."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def merged(sketches: DataFrame, period: str, ranks: list[float]) -> DataFrame:
    """(period, key, n, n_items, q0, q1, ..): sketches of days merged to periods (`week`, `month`, ..), with estimates of distinct items and of the quantiles at `ranks`. Raw rows are not read again."""
    whole = sketches.groupBy(F.date_trunc(period, "day").cast("date").alias("period"), "key").agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    at = [F.kll_sketch_get_quantile_double("quantiles", F.lit(float(r))).alias(f"q{i}") for i, r in enumerate(ranks)]
    return whole.select("period", "key", "n", F.hll_sketch_estimate("items").alias("n_items"), *at)
