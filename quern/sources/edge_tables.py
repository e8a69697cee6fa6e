"""Edge tables in buckets, and joins chosen by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, about, and buckets of a table at most.
ROWS, BUCKETS = 1 << 22, 1 << 14
#: Bytes that a side of a join may have to be sent to all executors.
SENT = 32 << 20


def buckets_for(rows: int) -> int:
    """A power of two, so that tables of any two sizes have buckets that fit each other."""
    return min(BUCKETS, 1 << max(0, -(-rows // ROWS) - 1).bit_length())


def write_buckets(edges: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> int:
    """Save `edges` as the table `name`, in buckets by the hash of `keys` and sorted by them; how many there are.

    Rows are dealt as the buckets are, so each bucket is one file, and one shuffle now
    saves one for each later join or aggregate by these keys. Without `buckets` the rows
    are counted for it. An existing table is replaced. Nulls are a key like others.
    """
    n = buckets or buckets_for(edges.count())
    edges.repartition(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return n


def measured_bytes(rows: DataFrame, most: int = SENT) -> int:
    """Bytes of the rows' values, texts and arrays as they are, counted until `most` is passed by rows alone. At least one byte a row."""
    width = F.lit(0)
    for f in rows.schema.fields:
        kind = f.dataType.simpleString()
        own = F.octet_length(F.col(f"`{f.name}`")) if kind in ("string", "binary") else F.lit(16) if kind.startswith("decimal") else F.lit(8) if kind.split("<")[0] not in ("array", "map", "struct", "variant") else F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        width = width + F.coalesce(own.cast("long"), F.lit(0)) + 8
    return rows.limit(most + 1).agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", sent: int = SENT) -> DataFrame:
    """`left` joined with `right` by equal keys: `right` is sent to all executors only if its values were counted and have `sent` bytes or fewer; else both sides are merged, by their buckets where they have the same. The rows are the same either way."""
    if how in ("right", "right_outer", "full", "full_outer", "outer"):
        return left.join(right.hint("merge"), on, how)
    return left.join(F.broadcast(right) if measured_bytes(right, sent) <= sent else right.hint("merge"), on, how)
