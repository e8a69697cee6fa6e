"""Approximate nearest neighbours by inner product, with an inverted multi-index.

The two halves of a vector are quantised separately, by k centroids each; an entry
belongs to the cell of its two centroids. A query walks the pairs of centroids from
the largest sum of inner products down, with a heap, until the cells that it has met
hold a given share of all entries. The entries of those cells are ranked by their
exact inner product. How large the share has to be is measured on the sample that
the centroids are fitted to.

Entries are dealt into shards of about SHARD rows by cell (a cell with more rows is
dealt into several). A shard meets the queries that visit it, in blocks of about
QUERY_BLOCK where there are more, and gives the best of every query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored
from ._text import mix

#: Vectors that the centroids and the share are fitted to, at most.
FIT = 20_000
#: Queries of the sample that the share is measured on.
FIT_QUERIES = 256
#: Centroids of a half, at most.
CENTROIDS = 64
#: Part of the true neighbours in the sample that the visited cells have to hold.
TARGET = 0.96
#: Entries that a walk meets at least, whatever the share.
LEAST = 100
SHARD, QUERY_BLOCK, AT_ONCE = 20_000, 4096, 512
#: Queries whose walks are made in one task.
WALKS = 256


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; centroids that lose all rows stay."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


class MultiIndex:
    def __init__(self, sample: np.ndarray, k: int, seed: int = 3):
        self.half = max(1, sample.shape[1] // 2)
        self.first, self.second = _means(sample[:, : self.half], k, seed), _means(sample[:, self.half :], k, seed + 1)
        self.k = k

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.first) * self.k + _nearest(x[:, self.half :], self.second)

    def walk(self, q: np.ndarray, count: np.ndarray, enough: float) -> list[int]:
        """Cells from the nearest on, until they hold `enough` entries: multi-sequence traversal of two sorted lists with a heap."""
        a, b = self.first @ q[: self.half], self.second @ q[self.half :]
        i, j = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = (-a[i]).tolist(), (-b[j]).tolist()
        i, j = i.tolist(), j.tolist()
        k, heap, out, held = self.k, [(a[0] + b[0], 0, 0)], [], 0
        while heap and held < enough:
            _, u, v = heapq.heappop(heap)
            cell = i[u] * k + j[v]
            n = int(count[cell])
            if n:
                out.append(cell)
                held += n
            # (u, v) opens its right neighbour; the first of a row opens the next row
            if v + 1 < k:
                heapq.heappush(heap, (a[u] + b[v + 1], u, v + 1))
            if v == 0 and u + 1 < k:
                heapq.heappush(heap, (a[u + 1] + b[0], u + 1, 0))
        return out

    def share(self, sample: np.ndarray, top: int, target: float) -> float:
        """Part of the entries that a walk has to meet so that `target` of the true neighbours in the sample are among them."""
        cell = self.cells(sample)
        count = np.bincount(cell, minlength=self.k**2)
        needs = []
        for r in np.linspace(0, len(sample) - 1, min(FIT_QUERIES, len(sample))).astype(int):
            score = sample @ sample[r]
            score[r] = -np.inf
            order = self.walk(sample[r], count, np.inf)
            held = dict(zip(order, np.cumsum(count[order]).tolist(), strict=True))
            near = np.argpartition(-score, min(top, len(score) - 1))[:top]
            needs += [held[c] / len(sample) for c in cell[near].tolist()]
        return float(np.quantile(needs, target)) if needs else 1.0


def _best(top_score, top_id, q, own, e, ids, visit, cell, top):
    """The best `top` of what each query had and of the entries `e` of the cells that it visits."""
    s = np.full((len(q), len(e)), -np.inf)
    edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rows = np.flatnonzero(visit[:, cell[a]])
        if len(rows):
            s[rows[:, None], np.arange(a, b)] = q[rows] @ e[a:b].T
    s[own[:, None] == ids[None, :]] = -np.inf
    # a matrix product rounds by place, so equal vectors can differ in the last bits: keep what is within that of the best, and score it anew
    slack = 1e-12 * (np.linalg.norm(q, axis=1) * np.linalg.norm(e, axis=1).max() + 1e-300)
    both = np.concatenate([top_score, s], axis=1)
    least = -np.partition(-both, top - 1, axis=1)[:, top - 1] - slack
    row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    exact = (q[row] * e[col]).sum(axis=1)
    old_row, old_col = np.nonzero(top_score > -np.inf)
    row = np.concatenate([old_row, row])
    score = np.concatenate([top_score[old_row, old_col], exact])
    vec = np.concatenate([top_id[old_row, old_col], ids[col]])
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < top
    out_score, out_id = np.full_like(top_score, -np.inf), np.zeros_like(top_id)
    out_score[row[keep], rank[keep]], out_id[row[keep], rank[keep]] = score[keep], vec[keep]
    return out_score, out_id


def _usable(x: Column) -> Column:
    """Not null, not zero, all components finite numbers."""
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ok & F.exists(x, lambda v: v != 0)


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id `every` divides, the `top` nearest of all other rows (columns vec_id and embedding are read; others are left alone).

    Nearest first by inner product in double precision, ties to the smaller vec_id.
    Vectors that are null, empty, zero, or hold a null or a number that is not finite
    take no part, nor do rows with a null vec_id or a length other than the commonest
    (the larger, if tied). Rows with the query's vec_id are its own; equal rows count
    once. Where rows of one vec_id have different vectors, the one asks whose bytes are
    the least. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null").where(_usable(F.col("x")))
    sizes = clean.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    d = sizes["d"]
    clean = clean.where(F.size("x") == d)
    sample = np.stack([np.array(r["x"]) for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(FIT).collect()])
    index = MultiIndex(sample, max(1, min(CENTROIDS, int(len(sample) ** 0.5) // 2)))
    share = index.share(sample, top, target)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(shared.value.cells(v).astype(np.int32))], names=["vec_id", "v", "cell"])

    placed = stored(clean.dropDuplicates(["vec_id", "x"]).mapInArrow(assign, "vec_id long, v binary, cell int"))
    # at most k * k rows
    per_cell = placed.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    count = np.zeros(index.k**2, np.int64)
    count[per_cell["cell"]] = per_cell["n"]
    n = int(count.sum())
    shards = max(1, -(-n // SHARD))
    parts = np.maximum(1, -(-count // SHARD))
    enough = max(share * n, LEAST)

    def shard(cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix(cell.astype(np.uint64) * np.uint64(1_000_003) + part.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cell = b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            part = (mix(ids.astype(np.int64).view(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(shard(cell, part), pa.int32())], names=["vec_id", "v", "cell", "shard"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, met = [], []
            for raw in b.column(1).to_pylist():
                cells = np.array(shared.value.walk(np.frombuffer(raw), count, enough), np.int64)
                bits = np.zeros(index_size, bool)
                bits[cells] = True
                seen.append(np.packbits(bits).tobytes())
                k = np.repeat(cells, parts[cells])
                p = np.arange(len(k)) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                met.append(np.unique(shard(k, p)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seen, pa.binary()), pa.array(met, pa.list_(pa.int32()))], names=["query_id", "v", "seen", "shards"])

    index_size = index.k**2
    asked = stored(placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    # few bytes a query, but much work: dealt out by number
    walked = stored(asked.repartition(max(1, -(-asked.count() // WALKS))).mapInArrow(visits, "query_id long, v binary, seen binary, shards array<int>"))
    visiting = walked.withColumn("shard", F.explode("shards")).drop("shards")
    # only the entries of a shard that more than QUERY_BLOCK queries visit are copied, and only as often as those fill blocks
    load = walked.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    queries = visiting.join(load, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    entries = placed.mapInArrow(deal, "vec_id long, v binary, cell int, shard int").join(load, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        right = right.sort_values(["cell", "vec_id"])
        e, ids, cell = np.frombuffer(b"".join(right["v"])).reshape(-1, d), right["vec_id"].to_numpy(), right["cell"].to_numpy()
        out = []
        for a in range(0, len(left), 128):
            part = left.iloc[a : a + 128]
            q = np.frombuffer(b"".join(part["v"])).reshape(-1, d)
            own = part["query_id"].to_numpy()
            visit = np.unpackbits(np.frombuffer(b"".join(part["seen"]), np.uint8).reshape(len(part), -1), axis=1)[:, :index_size].astype(bool)
            score, vec = np.full((len(part), top), -np.inf), np.zeros((len(part), top), np.int64)
            for b in range(0, len(e), AT_ONCE):
                s = slice(b, b + AT_ONCE)
                score, vec = _best(score, vec, q, own, e[s], ids[s], visit, cell[s], top)
            row, col = np.nonzero(score > -np.inf)
            out.append(pd.DataFrame({"query_id": own[row], "vec_id": vec[row, col], "score": score[row, col]}))
        return pd.concat(out, ignore_index=True)

    keys = ["shard", "block"]
    found = queries.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
