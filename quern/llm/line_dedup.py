"""Global deduplication of multi-line chunks, with DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines is taken at each line; a
chunk ends where it is a local minimum. Whether a line ends a chunk depends on the
lines around it alone, so a passage that two documents share is cut alike in both,
wherever it stands; and two ends are never neighbours, so no chunk is shorter than
two lines, unless its document is. A run of equal lines has equal rolling hashes, none
of which is a minimum: there every second line ends a chunk, counted from the start of
the run, so that runs of different length have most of their chunks in common.

First only hashes of chunks are shuffled. The bodies of those whose hash repeats are
then grouped by their bytes, and the first of each group stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import stored

#: Modulus and factor of the rolling hash: a prime below 2 ** 32, so no product leaves 64 bits.
_PRIME, _FACTOR = 4294967291, 31


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _digest(x: Column, digits: int) -> Column:
    """The first hexadecimal digits of MD5 as a number."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, digits), 16, 10).cast("long")


def _ends(lines: Column) -> Column:
    """Numbers of the lines, from 0, that end a chunk."""
    last = F.size(lines) - 1
    hashes = F.transform(lines, lambda x: _digest(x, 8))
    rolled = lambda h: F.transform(h, lambda x, i: (F.coalesce(F.get(h, i - 1), F.lit(0)) * _FACTOR + x) % _PRIME)
    least = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == F.size(r) - 1) | ((i >= 1) & (i <= F.size(r) - 3) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))))

    def of_runs(r: Column, starts: Column) -> Column:
        """Every second line of each run of equal rolling hashes, from its third on, but for its last one."""
        stop = lambda k: F.least(F.coalesce(F.get(starts, k + 1), F.size(r)) - 2, F.size(r) - 3)
        return F.flatten(F.transform(starts, lambda t, k: F.when(stop(k) >= t + 2, F.sequence(t + 2, stop(k), F.lit(2))).otherwise(F.array().cast("array<int>"))))

    starts = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (F.get(r, i) != F.get(r, i - 1)))
    both = lambda r: let(starts(r), lambda s: F.when(F.size(s) > F.size(r) - 3, least(r)).otherwise(F.array_sort(F.concat(least(r), of_runs(r, s)))))
    return F.when(last < 3, F.array(last)).otherwise(let(hashes, lambda h: let(rolled(h), both)))


def _code(begin: Column, size: Column) -> Column:
    """Where a chunk begins, counting lines from 0, and how many lines it has, as one number: they sort by `begin`, and sets of them are compared by hash."""
    return F.shiftleft(begin.cast("long"), 31).bitwiseOR(size.cast("long"))


def _begin(code: Column) -> Column:
    return F.shiftright(code, 31).cast("int")


def _size(code: Column) -> Column:
    return code.bitwiseAND((1 << 31) - 1).cast("int")


def _chunks(text: Column) -> Column:
    """Array of (code, hash) of a text's chunks; the hash of a single line is null."""

    def of(lines: Column, ends: Column) -> Column:
        def chunk(end: Column, no: Column) -> Column:
            begin = F.coalesce(F.get(ends, no - 1) + 1, F.lit(0))
            return let(F.struct(begin.alias("begin"), (end - begin + 1).alias("size")), lambda s: F.struct(_code(s["begin"], s["size"]).alias("code"), F.when(s["size"] > 1, _digest(F.array_join(F.slice(lines, s["begin"] + 1, s["size"]), "\n"), 15)).alias("hash")))

        return F.transform(ends, chunk)

    return let(F.split(text, "\n"), lambda lines: let(_ends(lines), lambda ends: of(lines, ends)))


def _whole() -> Column:
    """The text, empty for null. An expression, so that no second copy of the text is shuffled."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _named(docs: DataFrame) -> DataFrame:
    """`docs` with a name for each document, the same for rows equal in doc_id and text; it is never null, so it joins as it is."""
    name = F.md5(F.concat_ws(":", F.col("doc_id").cast("long"), F.md5(_whole().cast("binary"))).cast("binary"))
    return docs.withColumn("__quern_name", F.coalesce(name, F.lit("")))


def _removals(docs: DataFrame) -> DataFrame:
    """`docs` with __quern_gone: the codes of the chunks that go, in order, or null."""
    named = _named(docs)
    # names of their own, as `docs` may have columns of any other name
    of = F.struct(F.col("doc_id").cast("long").alias("id"), F.col("__quern_name").alias("name"))
    chunks = stored(named.select(of.alias("of"), F.explode(_chunks(_whole())).alias("c")).where("c.hash is not null").select("of", "c.code", "c.hash"))
    # pre-aggregated before the shuffle: a chunk in every document is one row a task. Stored, so that the join has both sides shuffled for it alone, and a hot hash can be split
    often = stored(chunks.groupBy("hash").agg(F.min(F.struct("of", "code")).alias("least"), F.max(F.struct("of", "code")).alias("most")).where("least <> most").select("hash"))
    lists = chunks.join(often, "hash", "left_semi").groupBy(F.col("of.name").alias("__quern_key")).agg(F.collect_set("code").alias("__quern_again"))
    marked = named.join(lists, F.col("__quern_name") == F.col("__quern_key"), "left").drop("__quern_key")
    again = F.col("__quern_again")
    bodies = marked.where(again.isNotNull()).select(
        of.alias("of"),
        # of all columns: so that this step reads the same shuffle of the documents as the last one, and their texts are moved once
        F.xxhash64(*(x.name for x in docs.schema if "map<" not in x.dataType.simpleString() and x.dataType.simpleString() != "variant")).alias("row"),
        let(F.split(_whole(), "\n"), lambda x: F.transform(again, lambda c: F.struct(c.alias("code"), F.array_join(F.slice(x, _begin(c) + 1, _size(c)), "\n").alias("body")))).alias("all"),
    )
    # in a step of its own: else the whole text would be read again for each chunk
    bodies = bodies.select("of", "row", F.explode("all").alias("c"))
    # bytes are compared here: a chunk goes only where the same body stands before it
    firsts = bodies.groupBy("c.body").agg(F.min(F.struct("of", F.col("c.code").alias("code"))).alias("first"), F.max("row").alias("row")).where("row is not null")
    stays = firsts.groupBy(F.col("first.of.name").alias("__quern_key")).agg(F.collect_set("first.code").alias("__quern_first"))
    kept = marked.join(stays, F.col("__quern_name") == F.col("__quern_key"), "left").drop("__quern_key")
    gone = F.sort_array(F.array_except(again, F.coalesce("__quern_first", F.array().cast("array<bigint>"))))
    return kept.withColumn("__quern_gone", F.when(again.isNotNull(), gone)).drop("__quern_again", "__quern_first")


def _rest(lines: Column) -> Column:
    """The lines outside the chunks that go: what stands before each of them, and after the last."""

    def between(i: Column, gone: Column, lines: Column) -> Column:
        start = F.coalesce(_begin(F.get(gone, i - 1)) + _size(F.get(gone, i - 1)), F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(_begin(F.get(gone, i)), F.size(lines)) - start)

    return let(F.struct(lines.alias("lines"), F.col("__quern_gone").alias("gone")), lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["gone"])), lambda i: between(i, s["gone"], s["lines"]))))


def _removed() -> Column:
    """How many lines go."""
    return F.coalesce(F.aggregate("__quern_gone", F.lit(0), lambda a, c: a + _size(c)), F.lit(0))


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for each row of `docs` (doc_id and text are read; other columns are left alone).

    Of a multi-line chunk that stands in several places, also of one document, the one
    of the smallest doc_id stays, and there the first. A null doc_id comes before all
    others. Rows equal in doc_id and text are one document: each keeps the same lines.
    Lines are cut at line feeds alone; a text without removals is returned as it is, null
    as an empty text. Texts of one line lose nothing; an empty table gives no rows.
    """
    text = F.when(F.size("__quern_gone") > 0, F.array_join(_rest(F.split(_whole(), "\n")), "\n")).otherwise(_whole())
    return _removals(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.split(_whole(), "\n")).cast("long").alias("n_lines"), _removed().cast("long").alias("n_removed"), text.alias("text"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with `text` (and n_chars, where there is one) as `line_dedup` leaves it; documents that lose all their lines go."""
    lines = F.split(_whole(), "\n")
    left = _removals(docs).where(_removed() < F.size(lines))
    text = F.when(F.size("__quern_gone") > 0, F.array_join(_rest(lines), "\n")).otherwise(F.col("text"))
    changed = left.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size("__quern_gone") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


SQL = """
WITH l AS (
    SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i, len(x) AS n
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, (31 * coalesce(lag(h) OVER w, 0) + h) % 4294967291 AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN r = lag(r) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM r)),
j AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1 AS j FROM f),
e AS (SELECT *, CASE WHEN i = n - 1 THEN 1 WHEN n < 4 OR i > n - 3 THEN 0
             WHEN i >= 1 AND r < lag(r) OVER w AND r <= lead(r) OVER w THEN 1
             WHEN j >= 2 AND j % 2 = 0 AND r = lead(r) OVER w THEN 1 ELSE 0 END AS ends
      FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS no FROM e),
b AS (SELECT doc_id, no, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, no),
k AS (SELECT *, size > 1 AND row_number() OVER (PARTITION BY body, size > 1 ORDER BY doc_id NULLS FIRST, no) > 1 AS gone FROM b)
SELECT doc_id, sum(size)::BIGINT AS n_lines, coalesce(sum(size) FILTER (gone), 0)::BIGINT AS n_removed,
       coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
FROM k GROUP BY doc_id"""
