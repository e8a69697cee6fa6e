"""Resampling of documents towards a target: hashed n-gram importance weights and a Gumbel draw, in Spark SQL.

Words, pairs and triples of neighbours are exploded from arrays, and each feature's
bucket is its CRC-32 modulo BUCKETS. The buckets of each word's place are written
once, as three short numbers beside the number of the document's row; counts and sums
read that. Counting is a grouped aggregate of at most BUCKETS rows a task, so the
gain table, one row a bucket, is broadcast at any size of corpus. Documents are then
ranked by a distributed sort: each range partition numbers its rows from 0, and what
the partitions before it hold is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored

#: Number of buckets; a short number holds each.
BUCKETS = 10_000
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words in order, A-Z in lower case. lower() does that for texts of ASCII alone, and faster."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))
    return F.array_remove(F.split(lowered, _GAPS), "")


def _bucket(*words: Column) -> Column:
    """Of the words joined by spaces; null if one is null."""
    feature = words[0]
    for w in words[1:]:
        feature = F.concat(feature, F.lit(" "), w)
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("short")


def places(docs: DataFrame) -> DataFrame:
    """(row, doc_id, one, two, three): for each word of each row of `docs` the buckets of the features that start there, null where the text ends before; a row without words has one of nulls."""
    worded = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("w"))
    shifted = lambda k: F.slice("w", F.lit(1 + k), F.size("w"))
    runs = worded.select("row", "doc_id", F.inline_outer(F.arrays_zip(F.col("w").alias("a"), shifted(1).alias("b"), shifted(2).alias("c"))).alias("a", "b", "c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return runs.select("row", "doc_id", _bucket(a).alias("one"), _bucket(a, b).alias("two"), _bucket(a, b, c).alias("three"))


def _features(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(*columns, F.explode(F.array("one", "two", "three")).alias("bucket"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain): a row for each bucket that `source` or `target` (tables of `places`) have, BUCKETS at most."""
    counted = lambda x: _features(x).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    both = counted(source).select("bucket", F.col("n").alias("s"), zero.alias("t")).unionByName(counted(target).select("bucket", zero.alias("s"), F.col("n").alias("t")))
    everything = Window.partitionBy()
    totals = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).select("bucket", "s", "t", F.sum("s").over(everything).alias("ss"), F.sum("t").over(everything).alias("tt"))
    number = lambda x, plus: F.col(x).cast("double") + F.lit(float(plus))
    ratio = number("t", 1) * number("ss", BUCKETS) / (number("s", 1) * number("tt", BUCKETS))
    return totals.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def _gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 G) of a standard Gumbel number that the id and the seed decide; a null id counts as an empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` with the column `place`: 1 for the first row in `order`. One range shuffle; only one count a partition is brought together."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(sorted_rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # one row a partition
    return numbered.join(F.broadcast(offsets), "__part").withColumn("place", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def resampled(docs: DataFrame, target: DataFrame, seed: int = 42, percent: int = 5) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of `docs` (doc_id and text are read; other columns are left alone), drawn towards the texts of `target`.

    weight sums the gains of a text's features, 0 without any; score adds the Gumbel
    number of its doc_id. rank is the place among the `percent` of all rows with
    LEAST_WORDS words or more that score highest, null for the rest; ties go to the
    smaller doc_id (nulls last), then to the row with fewer features. A null or empty
    text has no features. Repeated rows are each scored and may each be drawn. An empty
    `docs` gives no rows; an empty `target` makes rare features gain alike.
    """
    # written once: both the counts and the sums read the same numbers of rows
    found = stored(places(docs))
    table = gains(found, places(target.select(F.lit(None).alias("doc_id"), "text")))
    summed = _features(found, "row", "doc_id").join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id")
    weighed = summed.agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    # w words have w + (w - 1) + (w - 2) features, from two words on
    enough = F.col("n_features") >= 3 * LEAST_WORDS - 3
    scored = stored(weighed.select("row", "doc_id", "n_features", "weight", (F.col("weight") + _gumbel(F.col("doc_id"), seed)).alias("score"), enough.alias("enough")))
    drawn = scored.where("enough").count() * percent // 100
    placed = ranked(scored, [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")])
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("enough") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


#: For DuckDB, which has no CRC-32: its table of 256 numbers by the rule of the polynomial, then one step a byte of each distinct feature.
SQL = f"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
texts AS (SELECT true AS own, doc_id AS id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT row_number() OVER () AS row, own, id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT row, own, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x FROM (SELECT row, own, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k))),
names AS MATERIALIZED (SELECT x, hex(x) AS h FROM (SELECT DISTINCT x FROM f)),
b AS MATERIALIZED (SELECT x, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM names, crc),
n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN b USING (x) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM n),
sums AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN b USING (x) JOIN g USING (bucket) WHERE own GROUP BY row),
scored AS (SELECT row, id AS doc_id, len(w) >= {LEAST_WORDS} AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM w LEFT JOIN sums USING (row) WHERE own),
placed AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY enough) AS of FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN enough AND place <= 5 * of // 100 THEN place END::BIGINT AS rank FROM placed"""
