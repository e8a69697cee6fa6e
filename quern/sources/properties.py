"""Edges between nodes and the values of their JSON properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, node: str, json: str) -> DataFrame:
    """(node, json, v, reason): each row's JSON as a variant, read once; where it is none, v is null and reason says why, else reason is null."""
    read = rows.select(F.col(node).alias("node"), F.col(json).cast("string").alias("json")).withColumn("v", F.try_parse_json("json"))
    reason = (
        F.when(F.col("node").isNull(), "no node")
        .when(F.col("json").isNull(), "no properties")
        .when(F.trim("json") == "", "empty text")
        .when(F.col("v").isNull(), "not JSON")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "no object")
    )
    return read.withColumn("reason", reason)


def property_edges(rows: DataFrame, node: str, json: str, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected) of a table with a column of nodes and one of JSON objects.

    edges: node, path, kind, value, weight: how often a node has a value under a path.
    Objects and arrays are gone into, `depth` levels: `a.b` is a field of a field, and
    `a[]` any entry of an array, so equal entries are one edge of a larger weight. kind
    is the value's type: `string`, `number`, `boolean`, `null`; or `nested` for what lies
    deeper than that, whose value is its JSON. Empty objects and arrays have no values.
    rejected: node, json, reason, weight: what has no edges, and why. A text is parsed
    once, each level explodes what the level before left, and only counts are shuffled.
    """
    read = parsed(rows, node, json)
    rejected = read.where("reason is not null").groupBy("node", "json", "reason").agg(F.count("*").alias("weight"))
    level = read.where("reason is null").select("node", F.lit("").alias("path"), "v")
    leaves = None
    inner = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<")
    for d in range(depth):
        entries = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        # an entry of an array has no key
        below = entries.select("node", F.expr("if(key is null, path || '[]', if(path = '', key, path || '.' || key))").alias("path"), F.col("value").alias("v"))
        leaf = below.where(F.lit(d == depth - 1) | ~inner)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        level = below.where(inner)
    type_of = F.schema_of_variant("v")
    kind = F.when(F.is_variant_null("v"), "null").when(type_of == "STRING", "string").when(type_of == "BOOLEAN", "boolean").when(type_of.rlike("^(OBJECT|ARRAY)<"), "nested").otherwise("number")
    edges = leaves.select("node", "path", kind.alias("kind"), F.col("v").cast("string").alias("value"))
    return edges.groupBy("node", "path", "kind", "value").agg(F.count("*").alias("weight")), rejected
