"""Exact Jaccard join of documents on word shingles, by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct five-word shingles. All
sets are put in one order, rare tokens first, and frequent tokens are put in classes
by their counts. Two sets of Jaccard similarity t or more share a token among the
first |x| - ceil(t |x|) + 1 of each. A rare token is indexed alone. Where the first
token that two sets share is of a frequent class, prefixes are extended: the tokens
that only one of them holds cut those that they share into a bounded number of runs,
so that k shared tokens stand side by side in both sets' orders. For each class that a
set's prefix reaches, the combinations of k neighbours in its extended prefix are
indexed. k is two: with three the prefix has to reach so far that it ends among the
tokens that texts of one template all have, and combinations of these alone would be
indexed. Within a class the order is that of hashes, so that neighbours are seldom
tokens of one phrase, which have each other's documents.

A set that meets another under a class holds no token before that class in common
with it. That bounds what two sets share, and with it the sizes of partners.

Documents with equal sets are one class from the start. A bucket of classes under
one key is not expanded to pairs: its members are compared with the member that has
fewest rare tokens, then, where that leaves several components, with members chosen
by hash; links are closed to components each time. Only members of a bucket that are
still in different components, and whose bounds allow for a link, are joined by size.
A bound on the symmetric difference from 1,024 parity bits rejects most pairs before
sets are fetched to be intersected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import connected_components

from . import _bloom, _text
from ._spark import done_with, slices, stored

_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)
#: Parity bits of a set, at least; a large one has about as many as tokens.
BITS = 1024
#: At most so many tokens are classed as frequent; by counting, none of them stands in fewer than one in so many of all sets' tokens.
FREQUENT = 1 << 21
#: Tokens seen at most so often are rare, and a class reaches to so many times its least count.
OFTEN, STEP = 64, 8
#: Tokens in a combination, for the classes from the least frequent on; the last for all further ones.
TOGETHER_BY_CLASS = (2,)
#: Bits of the filters for keys that repeat and for classes whose sets are needed.
FILTER_BITS = 1 << 26
#: About so many tokens are compared with one set in a task.
TOGETHER = 1 << 19
#: Bytes of text, and tokens, that a task holds at once.
TEXT, HELD = 1 << 20, 1 << 18
#: Times that buckets are compared with members chosen by hash.
ROUNDS = 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the sorted distinct shingle hashes of each row."""
    h, at = _text.words(data, offsets, _text.SOLID)
    n = len(h)
    counts = np.diff(at)
    if not n:
        return np.zeros(0, _U), np.zeros(len(counts) + 1, np.int64)
    padded = np.concatenate([h, np.zeros(width, _U)])
    full = np.zeros(n, _U)
    for j in range(width):
        full += padded[j : n + j] * _MULTIPLIERS[j]
    full = _text.mix(full)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            s = _text.mix((h[a:b] * _MULTIPLIERS[: b - a]).sum(keepdims=True) + _U(b - a))
        sets.append(s)
        sizes[i] = len(s)
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """An id for each set, equal for equal sets; an empty set has 0."""
    sizes = np.diff(offsets)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_text.mix(tokens + _U(1)))))
    ids = _text.mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(_U))
    ids[sizes == 0] = 0
    return ids


def parity(tokens: np.ndarray) -> list[int]:
    """Bit b tells whether an odd number of tokens falls on b: two sets differ in at least as many tokens as their parities do in bits."""
    bits = BITS
    while bits < len(tokens):
        bits *= 2
    return np.packbits(np.bincount((tokens >> _U(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1).view(np.int64).tolist()


def _sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for batch in slices(batches, "text", TEXT):
        data, offsets = _text.utf8(batch.column(batch.schema.get_field_index("text")))
        tokens, at = shingle_sets(data, offsets, width)
        yield batch, tokens, at, set_ids(tokens, at)


def _survey(width: int, frequent: int):
    """Rows of two kinds: each document's class, size and parity; and tokens that repeat in the task, with their counts."""

    def f(batches):
        held, n_held, total = [], 0, 0
        counts: tuple = (np.zeros(0, _U), np.zeros(0, np.int64))
        seen: set[int] = set()

        def fold():
            nonlocal counts, held, n_held
            if not n_held:
                return
            allt = np.concatenate([*held, counts[0]])
            weight = np.concatenate([np.ones(n_held, np.int64), counts[1]])
            order = np.argsort(allt)
            allt, weight = allt[order], weight[order]
            first = np.flatnonzero(np.concatenate(([True], allt[1:] != allt[:-1])))
            sums = np.add.reduceat(weight, first)
            # those seen once in a stretch of tokens are not worth a place in a frequent class
            keep = sums > max(1, total // (2 * frequent))
            counts = (allt[first][keep], sums[keep])
            held, n_held = [], 0

        for batch, tokens, at, ids in _sets_of(batches, width):
            n = np.diff(at)
            new = np.zeros(len(ids), bool)
            for i, c in enumerate(ids.tolist()):
                if n[i] and c not in seen:
                    seen.add(c)
                    new[i] = True
            part = tokens[np.repeat(new, n)]
            held.append(part)
            n_held += len(part)
            total += len(part)
            if n_held > HELD:
                fold()
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(ids.view(np.int64)), pa.array(n), pa.array([parity(tokens[at[i] : at[i + 1]]) if new[i] else None for i in range(k)], pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
                names=["doc_id", "cid", "n", "parity", "token", "hits"],
            )
        fold()
        t, c = counts
        k = len(t) + 1
        # the last row, without a token, has the number of all tokens
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array(np.append(t, _U(0)).view(np.int64), mask=np.arange(k) == k - 1), pa.array(np.append(c, total))],
            names=["doc_id", "cid", "n", "parity", "token", "hits"],
        )

    return f


class Order:
    """The order of all tokens: those not in the table by their hash, then those of the table by class, and by hash within it."""

    def __init__(self, tokens: np.ndarray, hits: np.ndarray):
        steps = hits.min() * STEP ** np.arange(1, 22, dtype=np.float64) if len(hits) else np.zeros(0)
        classes = np.searchsorted(steps, hits)
        order = np.lexsort((_text.mix(tokens + _U(3)), classes))
        rank = np.empty(len(tokens), np.int32)
        rank[order] = np.arange(len(tokens))
        by_token = np.argsort(tokens)
        self.tokens, self.rank = tokens[by_token], rank[by_token]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.tokens >> _U(42)).astype(np.int64)] = True
        # the rank from which on each class but the first lies, and how many tokens are combined in each
        present, starts = np.unique(classes[order], return_index=True)
        self.starts = starts[1:]
        self.together = [TOGETHER_BY_CLASS[min(c, len(TOGETHER_BY_CLASS) - 1)] for c in present.tolist()]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Sort keys of tokens; those of frequent ones have the highest bit."""
        out = s >> _U(1)
        if len(self.tokens):
            maybe = np.flatnonzero(self.bits[(s >> _U(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.tokens, s[maybe]), len(self.tokens) - 1)
            true = self.tokens[at] == s[maybe]
            out[maybe[true]] = _U(1 << 63) + self.rank[at[true]].astype(_U)
        return out


def index_keys(order: Order, s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys under which one set is indexed, most tokens that it can share with a set it meets first under each, its rare tokens)."""
    n = len(s)
    shared = -(-percent * n // 100)
    own_only, lone = n - shared, (100 - percent) * n // percent
    order_keys = np.sort(order.keys(s))
    rare = int(np.searchsorted(order_keys, _U(1 << 63)))
    head = min(rare, own_only + 1)
    keys, most = [_text.mix(order_keys[:head] + _U(1))], [n - np.arange(head)]
    if rare <= own_only and lone:
        level = np.searchsorted(order.starts, (order_keys[rare:] - _U(1 << 63)).astype(np.int64), "right")
        for c in np.unique(level[: own_only + 1 - rare]).tolist():
            low = rare + int(np.searchsorted(level, c))
            # of d tokens that one of both sets holds alone, `low` stand before this class: the rest leave d - low + 1 runs of shared tokens, of which there are
            # n - d at least, and percent / (100 - percent) d. So a run of k is hardest to come by where d is n (100 - percent) / 100, or one more
            wanted = min(order.together[c], percent // (100 - percent) + 1)
            sure = min(wanted, (shared - 1) // (own_only - low + 1) + 1)
            if own_only < lone:
                sure = min(sure, (-(-percent * (own_only + 1) // (100 - percent)) - 1) // (own_only - low + 2) + 1)
            # a set that shares too few tokens to be sure of a run of that length is indexed under shorter ones too: of two such sets, the surer one's length is common to both
            for k in range(sure, wanted + 1):
                # among the (k - 1) (d - low + 1) + 1 first shared tokens k are neighbours in both sets, and d of its own at most stand between
                ext = order_keys[low : k * n * (100 - percent) // 100 - (k - 1) * (low - 1) + 1]
                if len(ext) >= k:
                    h = _text.mix(ext[: len(ext) - k + 1] + _U(2 + c + 64 * k))
                    for j in range(1, k):
                        h = _text.mix(h * _MULTIPLIERS[0] + ext[j : len(ext) - k + 1 + j])
                    keys.append(h)
                    most.append(np.full(len(h), n - low))
    return np.concatenate(keys), np.concatenate(most), rare


def _index(width: int, percent: int, order, owners, wanted=None):
    """The keys of all sets; with `wanted`, those that pass the filter, with their sets.

    Of equal sets that of the least doc_id is indexed, and perhaps others that the filter of owners lets pass.
    """

    def f(batches):
        table, seen = order.value, set()
        for batch, tokens, at, ids in _sets_of(batches, width):
            keys, cids, ranks, most = [], [], [], []
            own = _bloom.has(owners.value, ids ^ pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False).view(_U))
            for i in np.flatnonzero(own & (np.diff(at) > 0)):
                if ids[i] in seen:
                    continue
                seen.add(ids[i])
                k, m, rare = index_keys(table, tokens[at[i] : at[i + 1]], percent)
                if wanted is not None:
                    pick = _bloom.has(wanted.value, k)
                    k, m = k[pick], m[pick]
                    cids.append(np.full(len(k), ids[i]))
                    ranks.append(np.full(len(k), (rare << 32) + at[i + 1] - at[i]))
                    most.append(m)
                keys.append(k)
            if keys and wanted is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["key"])
            elif keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cids).view(np.int64)), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(most))], names=["key", "cid", "rank", "most"])

    return f


def _emit_sets(width: int, wanted):
    def f(batches):
        bits, seen = wanted.value, set()
        for _, tokens, at, ids in _sets_of(batches, width):
            hit = np.flatnonzero(_bloom.has(bits, ids) & (np.diff(at) > 0))
            keep = []
            for i in hit.tolist():
                if ids[i] not in seen:
                    seen.add(ids[i])
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep].view(np.int64)), pa.array([tokens[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary())], names=["cid", "tokens"])

    return f


def _sets(needed: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cid, tokens) of the classes in `needed`, and perhaps of some others."""
    wanted = docs.sparkSession.sparkContext.broadcast(_bloom.build(needed, "cid", FILTER_BITS))
    return docs.select("text").mapInArrow(_emit_sets(width, wanted), "cid long, tokens binary").dropDuplicates(["cid"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, b_n) of classes whose sets are similar enough."""
    # a left side with many partners is met in several places
    parts = pairs.groupBy("a").agg(F.ceil(F.sum("b_n") / TOGETHER).alias("k"))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"))
    use = salted.select(F.col("a").alias("cid"), "a", "salt", F.lit(True).alias("left")).distinct().unionByName(salted.select(F.col("b").alias("cid"), "a", "salt", F.lit(False).alias("left")))
    met = use.join(sets, "cid")

    def compare(table: pa.Table) -> pa.Table:
        left = np.asarray(table["left"])
        tokens = table["tokens"]
        mine, out = np.frombuffer(tokens[int(np.argmax(left))].as_buffer(), _U), []
        for i in np.flatnonzero(~left).tolist():
            other = np.frombuffer(tokens[i].as_buffer(), _U)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * both >= percent * (len(mine) + len(other) - both):
                out.append(table["cid"][i].as_py())
        return pa.table({"a": pa.array([table["a"][0].as_py()] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return met.groupBy("a", "salt").applyInArrow(compare, "a long, b long")


def _may_link(percent: int, a: str, b: str, n: Column) -> Column:
    """Whether the parities a and b leave it open that two sets, of n tokens together, are similar enough."""
    # sizes that fit differ by less than a factor of two, so the longer parity is as long or twice that; its halves are laid over each other
    word = lambda x, at: f"coalesce(get({x}, {at}), 0L)"
    over = lambda x, y: f"if(size({x}) > size({y}), {word(x, f'i + size({y})')}, 0L)"
    differ = F.expr(f"aggregate(sequence(0, least(size({a}), size({b})) - 1), 0, (s, i) -> s + bit_count({word(a, 'i')} ^ {word(b, 'i')} ^ {over(a, b)} ^ {over(b, a)}))")
    return n * (100 - percent) >= differ * (100 + percent)


#: Words of 64 parity bits that are compared first.
SIGNATURE = 8
#: Buckets of more members test pairs while they are made.
FEW = 3
#: Bins of sizes for each factor of e.
BINS = 12


def _signature() -> Column:
    """Column parity laid over itself to SIGNATURE words: still at most as many bits differ as tokens do."""
    return F.expr(f"transform(sequence(0, {SIGNATURE - 1}), i -> aggregate(sequence(0, size(parity) div {SIGNATURE} - 1), 0L, (s, j) -> s ^ get(parity, i + {SIGNATURE} * j)))")


def _bin(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * BINS).cast("int")


def _bit(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)))


def _partners(n: Column, top: Column, percent: int) -> Column:
    """The bins of sizes that partners may have, as an array."""
    low, high = F.ceil(n * percent / 100), F.least(top, F.floor(n * 100 / percent))
    return F.when(high >= low, F.sequence(_bin(low), _bin(high))).otherwise(F.array().cast("array<int>"))


def _still_open(rows: DataFrame, percent: int) -> DataFrame:
    """Of the members (key, cid, n, top, component) of buckets, those that may still link with one of another component.

    `main` is the component that most of a bucket are in, `visits` has the bins in
    which a member outside it may have partners. A member stays if its bound allows
    for a size that another member has, of which one is outside the main component.
    """
    of = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    main = of.groupBy("key").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("members"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("most.component").alias("main"), "members")
    rows = rows.select("key", "cid", "n", "top", "component").join(main, "key").withColumn("bin", _bin(F.col("n")))
    outside = F.col("component") != F.col("main")
    sizes = rows.groupBy("key", "bin").agg(F.count("*").alias("k"), F.count_if(outside).alias("out"))
    taken = sizes.groupBy("key").agg(*(F.bit_or(F.when(F.col(c) >= least, _bit(F.col("bin"))).otherwise(F.lit(0).cast("long"))).alias(name) for name, c, least in (("one", "k", 1), ("two", "k", 2), ("out", "out", 1))))
    own = _bit(F.col("bin"))
    others = F.when(outside, F.col("one").bitwiseAND(F.bitwise_not(own)).bitwiseOR(F.col("two"))).otherwise(F.col("out"))
    visits = F.filter(_partners(F.col("n"), F.col("top"), percent), lambda b: _bit(b).bitwiseAND(F.col("others")) != 0)
    return stored(rows.join(taken, "key").withColumn("others", others).withColumn("visits", visits).where(F.size("visits") > 0).drop("one", "two", "out", "others"))


def _open_pairs(open_: DataFrame, classes: DataFrame, percent: int, may) -> DataFrame:
    """Pairs (x, y) of a member outside its bucket's main component with one of another component that no bound excludes."""
    meet = lambda rows: [rows.where("component <> main").withColumn("bin", F.explode("visits")).alias("x"), rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.bin") == F.col("y.bin")) & may("x.", "y.")]
    x, y, on = meet(open_.where(F.col("members") <= FEW))
    pairs = x.join(y, on).select("x.cid", "y.cid")
    # in a larger bucket a pair that shares many keys would be made for each: so a bound on its difference is tested while members are joined
    parities = classes.where("parity is not null").select("cid", _signature().alias("s"))
    signed = open_.where(F.col("members") > FEW).join(parities, "cid").select(*open_.columns, *(F.col("s")[i].alias(f"s{i}") for i in range(SIGNATURE)))
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SIGNATURE)))
    x, y, on = meet(signed)
    return pairs.union(x.join(y, on & ((F.col("x.n") + F.col("y.n")) * (100 - percent) >= differ * (100 + percent))).select("x.cid", "y.cid")).toDF("x", "y")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (columns doc_id and text are read; others are left alone).

    Words are runs of characters other than ASCII white space, A-Z in lower case.
    Two documents are linked when their sets' Jaccard similarity is `percent` % or
    more; component_id is the smallest doc_id that links reach. A document of fewer
    than `width` words has its whole sequence as its one shingle. Null or empty text,
    or text without words: no shingles, linked with nothing, component_id is its own
    doc_id. Rows with the same doc_id each count as documents of that id. A null
    doc_id keeps its row; it can link others but never names a component, unless the
    component has nothing else: then component_id is null. An empty table gives none.
    `percent` is 67 to 100: below that, neighbours in the order need not be shared.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be 67 to 100")
    return _components(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The same with cid, the id of the row's set, and component, the least one that links reach; both tell nothing of rows without shingles."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = stored(docs.mapInArrow(_survey(width, FREQUENT), "doc_id long, cid long, n long, parity array<long>, token long, hits long"))
    members = survey.where("cid is not null").select("doc_id", "cid", "n", "parity")
    hits = survey.where("token is not null").groupBy("token").agg(F.sum("hits").alias("hits"))
    total = survey.where("cid is null and token is null").agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    # at most FREQUENT tokens can each hold more than one in FREQUENT of all; so the table has a bound whatever the corpus
    often = hits.where(F.col("hits") > max(OFTEN, total // FREQUENT)).toArrow()
    order = spark.sparkContext.broadcast(Order(often["token"].to_numpy().view(_U), often["hits"].to_numpy()))
    # most keys are of one set alone: they are counted first, without their sets, and only those that repeat come with them
    owner = members.where("n > 0").groupBy("cid").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("least")).select(F.col("cid").bitwiseXOR(F.col("least")).alias("owner"))
    owners = spark.sparkContext.broadcast(_bloom.build(owner, "owner", FILTER_BITS))
    repeated = docs.mapInArrow(_index(width, percent, order, owners), "key long").groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    wanted = spark.sparkContext.broadcast(_bloom.build(repeated, "key", FILTER_BITS))
    # dealt by key once: members and what is said of all members of a key read the same exchange, and it is not stored
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = docs.mapInArrow(_index(width, percent, order, owners, wanted), "key long, cid long, rank long, most long").repartition(n_parts, "key").groupBy("key", "cid").agg(F.max("rank").alias("rank"), F.max("most").alias("most"))
    # `rank` is a set's number of rare tokens, then its size: the first member of a bucket is the one that differs least from what many share
    size = lambda x: F.col(x).bitwiseAND(0xFFFFFFFF)
    member = F.xxhash64("cid")
    sets_of_key = (
        index.groupBy("key")
        .agg(
            F.min(F.struct("rank", "cid")).alias("first"),
            F.count("*").alias("k"),
            F.xxhash64(F.bit_xor(member), F.sum(member.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(member, 32)), F.count("*")).alias("set"),
        )
        .where("k > 1")
        .select("key", "set", F.col("first.cid").alias("pivot"), size("first.rank").alias("pivot_n"))
    )
    # keys with the same members are one bucket: near copies share hundreds of keys, but few sets of members
    top = F.floor((100 + percent) * F.max("most") / percent) - F.max(size("rank"))
    buckets = stored(index.join(sets_of_key, "key").groupBy(F.col("set").alias("key"), "cid").agg(F.max(size("rank")).alias("n"), top.alias("top"), F.max("pivot").alias("pivot"), F.max("pivot_n").alias("pivot_n")))
    done_with()
    # used by each screen: stored, so that few pairs can be joined without another shuffle of it
    classes = stored(members.where("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.max("parity").alias("parity")))

    def screened(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"{x}_n"), F.col("parity").alias(f"{x}_parity"))
        distinct = stored(pairs.distinct())
        left = stored(distinct.join(side("a"), "a").join(side("b"), "b").where(_may_link(percent, "a_parity", "b_parity", F.col("a_n") + F.col("b_n"))).select("a", "b", "b_n"))
        done_with(distinct)
        return left

    fits = lambda x, y: F.greatest(x, y) * percent <= F.least(x, y) * 100
    star = screened(buckets.where("cid <> pivot").where(fits("pivot_n", "n")).select(F.col("pivot").alias("a"), F.col("cid").alias("b")))
    links = stored(_verified(star, _sets(_ends(star), docs, width), percent))
    found = connected_components(links, "a", "b").select(F.col("node").alias("cid"), "component")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = star.select(*ordered("a", "b"))
    done_with()
    open_ = _still_open(buckets.select("key", "cid", "n", "top").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid")), percent)
    merged = []
    for turn in range(ROUNDS + 1):
        if open_.isEmpty():
            break
        may = lambda x, y: reduce(lambda a, b: a & b, [F.col(f"{x}component") != F.col(f"{y}component"), fits(f"{x}n", f"{y}n"), F.col(f"{x}n") <= F.col(f"{y}top"), F.col(f"{y}n") <= F.col(f"{x}top")])
        if turn < ROUNDS:
            chosen = open_.groupBy("key").agg(F.min_by(F.struct("cid", "n", "top", "component"), F.xxhash64("key", "cid", F.lit(turn))).alias("p")).select("key", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("cid", "n", "top", "component")))
            pairs = open_.join(chosen, "key").where(may("", "p_")).select(*ordered("cid", "p_cid"))
        else:
            pairs = _open_pairs(open_, classes, percent, may).select(*ordered("x", "y"))
        done_with()
        rest = screened(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            continue
        # sets are large: those of the few pairs that are left are made again, not kept
        more = stored(_verified(rest, _sets(_ends(rest), docs, width), percent))
        tried = tried.union(rest.select("a", "b"))
        named = open_.select("cid", "component").distinct()
        edges = more.join(named.toDF("a", "u"), "a").join(named.toDF("b", "v"), "b").select("u", "v")
        step = stored(connected_components(edges, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("joined")))
        merged.append(step)
        open_ = _still_open(open_.select("key", "cid", "n", "top", "component").join(step, "component", "left").withColumn("component", F.coalesce("joined", "component")), percent) if turn < ROUNDS else open_
    found = members.where("n > 0").select("cid").distinct().join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    for step in merged:
        found = found.join(step, "component", "left").select("cid", F.coalesce("joined", "component").alias("component"))
    # a class takes the smallest doc_id of its own rows; a component that of its classes
    own = members.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least")).join(found, "cid")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    named = own.join(least, "component").select("cid", "component", "component_id")
    return members.join(named, "cid", "left").select("cid", "component", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_sets(width: int):
    """The rows with the ids of their sets."""

    def f(batches):
        for batch, _, _, ids in _sets_of(batches, width):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids.view(np.int64))], names=[*batch.schema.names, "__quern_cid"])

    return f


def _picked(first, second, inside: bool):
    """The rows whose last column, a hash, is in both filters; with inside=False those not in the first, and those without a hash. The hash is left out."""

    def f(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                h = batch.column(batch.num_columns - 1)
                known = pc.is_valid(h).to_numpy(zero_copy_only=False)
                hashes = pc.fill_null(h, 0).to_numpy(zero_copy_only=False)
                hit = known & _bloom.has(first.value, hashes)
                keep = hit & _bloom.has(second.value, hashes) if inside else ~hit
                if keep.any():
                    yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep))

    return f


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` but for those whose doc_id is `out` in `ids` (__quern_doc, out), which has each doc_id once.

    A filter of the ids that are out lets most other rows through where they lie. Ids
    that it takes for them by mistake are found among the ids alone and have a second
    filter: only rows that pass both are joined with them.
    """
    share = docs.sparkSession.sparkContext.broadcast
    h = F.xxhash64("__quern_doc").alias("h")
    out = share(_bloom.build(ids.where("out").select(h), "h", FILTER_BITS))
    mistaken = stored(ids.where("not out").select("__quern_doc", h).mapInArrow(_picked(out, out, True), "__quern_doc long"))
    doubt = share(_bloom.build(mistaken.select(h), "h", FILTER_BITS // 64))
    hashed = docs.withColumn("__quern_hash", F.expr("if(cast(doc_id as long) is null, null, xxhash64(cast(doc_id as long)))"))
    sure = hashed.mapInArrow(_picked(out, doubt, False), docs.schema)
    if mistaken.isEmpty():
        return sure
    return sure.unionByName(hashed.mapInArrow(_picked(out, doubt, True), docs.schema).join(mistaken, F.col("doc_id") == F.col("__quern_doc"), "left_semi"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their component; see jaccard_components.

    That is the one of the smallest doc_id. Where rows of one doc_id have different
    texts, each is judged by its own: of those linked with each other one stays, and
    one that is linked with none stays whatever goes. Rows equal in doc_id and text
    are one document, and one of them stays. Rows without doc_id stay: they can't be
    told apart. Empty texts are linked with nothing and stay.
    """
    found = stored(_components(docs, width, percent).where("doc_id is not null"))
    goes = F.coalesce(F.col("component_id") < F.col("doc_id"), F.lit(False))
    counted = stored(found.groupBy(F.col("doc_id").alias("__quern_doc")).agg(F.count("*").alias("rows"), F.max(goes).alias("goes")))
    # ids are shuffled, texts only of repeated ids and of the few that filters leave in doubt
    key = F.col("doc_id") == F.col("__quern_doc")
    again = counted.where("rows > 1").select("__quern_doc")
    alone = _without(docs, counted.withColumn("out", F.expr("goes or rows > 1")))
    if again.isEmpty():
        return alone
    # of the sets that a doc_id has in its component, the least; of rows with that set, and of empty texts, the least by hash and bytes
    sets = found.where(~goes & (F.col("n_shingles") > 0)).groupBy("doc_id", "component").agg(F.min("cid").alias("__quern_set")).select(F.col("doc_id").alias("__quern_doc"), "__quern_set")
    text = F.col("text").cast("string")
    read = docs.join(again, key, "left_semi").withColumn("__quern_row", F.struct(*docs.columns)).select(F.col("doc_id").cast("long").alias("__quern_doc"), text.alias("text"), "__quern_row")
    rows = read.mapInArrow(_with_sets(width), read.withColumn("__quern_cid", F.lit(0).cast("long")).schema)
    empty = F.col("__quern_cid") == 0
    kept = rows.where(empty).unionByName(rows.where(~empty).join(sets.withColumnRenamed("__quern_set", "__quern_cid"), ["__quern_doc", "__quern_cid"], "left_semi").select(*rows.columns))
    one = kept.groupBy("__quern_doc", "__quern_cid", F.when(empty, F.col("text")).alias("__quern_text")).agg(F.min_by("__quern_row", F.struct(F.xxhash64("text"), "text")).alias("__quern_row"))
    return alone.unionByName(one.select("__quern_row.*"))
