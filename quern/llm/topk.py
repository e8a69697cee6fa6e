"""Exact top-k search by inner product of integer vectors, with block-at-a-time pruning.

Each dimension is a term, and a vector holds its weight. Rows are put in order by the
pivot that they agree with most, and stretches of them are blocks: a block holds its
rows as a matrix (its forward index) and, for each term, the largest and the smallest
weight in it. The sum over a query's terms of the larger product bounds every score in
a block. A query goes through blocks in the order of these sums, and stops where they
fall below its k-th score. That starts from the rows of the query's own block.

Queries and blocks meet in tiles: strips of blocks times groups of queries, each a
bounded task of its own. Each strip of a tile is searched from the score that the
query brought along; the best of all strips are ranked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored

#: Rows of a block, numbers in a strip's matrix, and queries of a group at most, and how many of those are searched at once.
BLOCK, STRIP, GROUP, AT_ONCE = 128, 1 << 22, 1 << 13, 1 << 10
#: Vectors that the order of rows is fitted on, and pivots among them. They decide how much is pruned, never what is found.
FIT, PIVOTS = 2000, 64
_EXACT, _LARGEST = float(1 << 53), 2.0**1015
_BLOCKS = "part int, number long, at long, ids array<long>, asks array<int>, known array<double>, kind string, v binary"
_QUERIES = "ask long, query_id long, known double, kind string, v binary"
_FOUND = "ask long, query_id long, vec_id long, at long, score long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
_BLOCK_SCHEMA, _QUERY_SCHEMA, _FOUND_SCHEMA = (pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in x.split(", ")]) for x in (_BLOCKS, _QUERIES, _FOUND))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of `a` and `b`, whole numbers held as doubles. Doubles add them exactly below 2 ** 53; beyond, Python's integers do, held at the ends of 64 bits."""
    most = lambda x: np.abs(x).max(initial=0.0)
    if most(a) * most(b) * max(1, a.shape[1]) < _EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(y) for y in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1)


def padded(v: np.ndarray, width: int) -> np.ndarray:
    return v if v.shape[1] == width else np.pad(v, ((0, 0), (0, width - v.shape[1])))


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each query and block: the sum over terms of the larger of the products with the block's extremes."""
    return products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)


def best(query: np.ndarray, score: np.ndarray, place: np.ndarray, top: int) -> np.ndarray:
    """The entries that are among their query's `top` best, by query, then score, then place."""
    order = np.lexsort((place, -score, query))
    q = query[order]
    begins = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return order[rank < top]


class Searched:
    """Entries found for a group of queries so far, and the score that each query's next ones have to reach. met: how many pairs of query and block were scored."""

    def __init__(self, known: np.ndarray, top: int):
        self.top, self.least, self.met = top, known.copy(), 0
        self.query, self.score, self.place = np.zeros(0, np.int64), np.zeros(0, known.dtype), np.zeros(0, np.int64)

    def add(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        q, s, p = (np.concatenate(x) for x in zip((self.query, self.score, self.place), *found, strict=True))
        keep = best(q, s, p, self.top)
        self.query, self.score, self.place = q[keep], s[keep], p[keep]
        ends = np.cumsum(np.bincount(self.query, minlength=len(self.least)))
        full = np.flatnonzero(np.diff(ends, prepend=0) == self.top)
        self.least[full] = np.maximum(self.least[full], self.score[ends[full] - 1])


def search(q: np.ndarray, own: np.ndarray, known: np.ndarray, v: np.ndarray, place: np.ndarray, cuts: np.ndarray, top: int) -> Searched:
    """For each row of `q`, the `top` best rows of `v` among those that score `known` at least.

    Blocks of rows lie between `cuts`. place orders rows of equal score; a query's own row is the one whose place is in `own`.
    """
    low, high = (f.reduceat(v, cuts[:-1]).astype(np.float64) for f in (np.minimum, np.maximum))
    reach = bounds(q, low, high)
    state = Searched(known.astype(reach.dtype), top)
    order = np.argsort(-reach, axis=1, kind="stable")
    at, step = 0, 1
    while at < len(cuts) - 1:
        # the next blocks of each query, as far as their bounds reach its k-th score; each round is twice as long as the last
        blocks = order[:, at : at + step]
        asking, column = np.nonzero(np.take_along_axis(reach, blocks, 1) >= state.least[:, None])
        if not len(asking):
            break
        block = blocks[asking, column]
        state.met += len(block)
        by_block = np.argsort(block, kind="stable")
        asking, block = asking[by_block], block[by_block]
        found, held = [], 0
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(block)), strict=True):
            rows, who = slice(cuts[block[a]], cuts[block[a] + 1]), asking[a:b]
            s = products(q[who], v[rows].astype(np.float64))
            i, j = np.nonzero((s >= state.least[who][:, None]) & (place[rows][None, :] != own[who][:, None]))
            found.append((who[i], s[i, j], place[rows][j]))
            held += len(i)
            if held > 1 << 19:
                state.add(found)
                found, held = [], 0
        state.add(found)
        at, step = at + step, step * 2
    return state


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(floor(256 x) of all components, lengths) of a column of lists without nulls."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False) * 256.0), np.diff(column.offsets.to_numpy())


def _matrix(values: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` numbers, shorter ones ended by zeros, longer ones cut."""
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), values.dtype)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out[:, :width]


def _pivots(sample: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Directions that rows of the sample gather around."""
    length = np.linalg.norm(sample, axis=1, keepdims=True)
    unit = sample / np.where(length > 0, length, 1)
    pivots = unit[:PIVOTS].copy()
    for _ in range(rounds):
        near = (unit @ pivots.T).argmax(1)
        for k in np.unique(near):
            mean = unit[near == k].mean(0)
            pivots[k] = mean / (np.linalg.norm(mean) or 1)
    return pivots


def _kind(v: np.ndarray) -> str:
    """The smallest type that holds whole numbers as they are."""
    most = np.abs(v).max(initial=0.0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def _blocks(width: int, size: int, every: int, top: int):
    """Each Arrow batch of a sorted partition cut into blocks of `size` rows, with what each query among them knows from its block."""

    def block(ids: pa.Array, v: np.ndarray) -> dict:
        asks = np.flatnonzero((ids.fill_null(1).to_numpy() % every == 0) & ids.is_valid().to_numpy(zero_copy_only=False))
        known = np.full(len(asks), -np.inf)
        for i, a in enumerate(asks if len(v) > top else ()):
            least = np.sort(np.delete(products(v[a : a + 1], v)[0], a))[-top]
            # a number that a double can't hold is known a little less
            known[i] = least if abs(least) < _EXACT else np.nextafter(float(least), -np.inf)
        kind = _kind(v)
        return {"ids": ids.to_pylist(), "asks": asks.tolist(), "known": known.tolist(), "kind": kind, "v": v.astype(kind).tobytes()}

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            for a in range(0, b.num_rows, size):
                rows = b.slice(a, size)
                row = block(rows.column("vec_id"), _matrix(*_whole(rows.column("x")), width))
                yield pa.RecordBatch.from_pylist([{"part": rows.column("part")[0].as_py(), "number": number, "at": rows.column("at")[0].as_py(), **row}], _BLOCK_SCHEMA)
                number += 1

    return f


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each query of a block; ask is the number of its own row."""
    for b in batches:
        for r in b.to_pylist():
            if r["asks"]:
                size = len(r["v"]) // len(r["ids"])
                rows = [{"ask": r["at"] + i, "query_id": r["ids"][i], "known": k, "kind": r["kind"], "v": r["v"][i * size : (i + 1) * size]} for i, k in zip(r["asks"], r["known"], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, _QUERY_SCHEMA)


def _meet(width: int, top: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best rows of a strip of blocks for a group of queries."""
        out = []
        if left.num_rows and right.num_rows:
            kinds = right["kind"].to_pylist()
            parts = [np.frombuffer(raw, kind).reshape(len(ids), width) for raw, kind, ids in zip(right["v"].to_pylist(), kinds, right["ids"].to_pylist(), strict=True)]
            sizes = np.array([len(x) for x in parts])
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            v = np.concatenate(parts).astype(max(kinds, key=("<i2", "<i4", "<f8").index))
            ids = right["ids"].combine_chunks().flatten()
            at = np.repeat(right["at"].to_numpy(), sizes) + np.arange(len(v)) - np.repeat(cuts[:-1], sizes)
            # by vec_id, nulls last, then number of the row
            order = np.lexsort((at, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            place = np.empty(len(v), np.int64)
            place[order] = np.arange(len(v))
            place_of = dict(zip(at.tolist(), place.tolist(), strict=True))
            for part in left.to_batches(AT_ONCE):
                q = np.stack([np.frombuffer(raw, kind).astype(np.float64) for raw, kind in zip(part["v"].to_pylist(), part["kind"].to_pylist(), strict=True)])
                own = np.array([place_of.get(a, -1) for a in part["ask"].to_pylist()])
                got = search(q, own, part["known"].to_numpy(), v, place, cuts, top)
                row = order[got.place]
                out.append(pa.table([part["ask"].take(pa.array(got.query)), part["query_id"].take(pa.array(got.query)), ids.take(pa.array(row)), pa.array(at[row]), pa.array(got.score.astype(np.int64))], schema=_FOUND_SCHEMA))
        return pa.concat_tables(out) if out else _FOUND_SCHEMA.empty_table()

    return f


def top_inner_products(vectors: DataFrame, every: int = 50, top: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id `every` divides, the `top` other rows of the largest inner product (columns vec_id and embedding are read; others are left alone).

    Components count as floor(256 x). Ties go to the smaller vec_id, nulls last.
    Vectors that are null or hold a null, a NaN or an infinite number take no part; of
    two vectors of different length, the shorter one has zeros for what it lacks, an
    empty one scores 0. Each row is a candidate, and a query if its vec_id says so:
    rows with one vec_id find each other. A null vec_id asks nothing. Scores beyond 64
    bits are held at their ends, and tie there. A table of fewer rows gives all; an empty one none.
    """
    spark = vectors.sparkSession
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    clean = read.where("x is not null").where(F.forall("x", lambda c: F.coalesce(F.abs(c) < _LARGEST, F.lit(False))))
    rows, width = clean.agg(F.count("*"), F.max(F.size("x"))).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    size = min(BLOCK, max(1, STRIP // width))
    sample = [r["x"] for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(FIT).collect()]
    pivots = _pivots(_matrix(np.array([c for x in sample for c in x]), np.array([len(x) for x in sample]), width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            near = (_matrix(x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy()), width) @ pivots.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["vec_id", "x", "pivot"])

    order = ["pivot", "vec_id", "x"]
    ordered = clean.mapInArrow(assign, "vec_id long, x array<double>, pivot int").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ordered.select("vec_id", "x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    blocks = stored(numbered.mapInArrow(_blocks(width, size, every, top), _BLOCKS))
    # a row a partition
    counts = blocks.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    n_blocks, queries = blocks.agg(F.count("*"), F.sum(F.size("asks"))).first()
    # strips as large as their bound lets them be, but for small tables one for each core
    strips = max(-(-rows // max(1, STRIP // width)), min(n_blocks, spark.sparkContext.defaultParallelism))
    length, groups = -(-n_blocks // strips), max(1, -(-queries // GROUP))
    strip = F.floor((F.col("number") + F.col("before")) / length).cast("int")
    right = blocks.join(F.broadcast(offsets), "part").select("at", "ids", "kind", "v", strip.alias("strip"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part_of"))
    left = blocks.mapInArrow(_queries, _QUERIES).withColumn("part_of", F.pmod(F.xxhash64("ask"), F.lit(groups)).cast("int")).withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    tile, tiles = ["strip", "part_of"], min(strips * groups, 1 << 14)
    found = left.repartition(tiles, *tile).groupBy(*tile).cogroup(right.repartition(tiles, *tile).groupBy(*tile)).applyInArrow(_meet(width, top), _FOUND)
    ranking = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    return found.withColumn("rank", F.row_number().over(ranking).cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


#: Every query beside every other row.
SQL = """
WITH v AS (SELECT row_number() OVER () AS at, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.at AS ask, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v AS q JOIN v AS c ON q.at <> c.at WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
