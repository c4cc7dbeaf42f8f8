"""Nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors get one more component that brings all to the greatest norm, and queries are brought to that norm, so that the largest inner
product is the least distance. A table hashes a vector by `width` projections on normal vectors, cut into cells; a query visits cells
around its own in the order of estimated success. A neighbour at distance r is off by a normal deviate of r in each projection,
so the chance that it lies in a given cell is a product over the projections; all perturbations by at most REACH
cells a projection are ordered by it. Each query has its own r, that of its k-th neighbour as told by a bounded sample of the table, and visits as many
cells as it takes to find such a neighbour with the wanted chance. So isolated queries visit more than those in a cluster.
Candidates of all tables are scored exactly, in double precision.

A query that all cells in reach would not give the wanted chance, and one that found fewer than k vectors, is compared with all vectors,
in blocks.

Equal vectors are one vector with its least ids, so copies weigh nothing. Buckets are dealt over slots, a large bucket over
several; a task holds the vectors of its slots, one after the other, while the queries that probe them stream by.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, share_code, spread, table

#: Vectors of a bucket in one slot at least, vectors of a slot on average, queries scored at once, large buckets that the driver holds.
LARGE, SLOT, BLOCK, MOST = 4096, 8192, 256, 20_000
#: Cells by which a perturbation may leave the query's own in each projection.
REACH = 2


def normal_share(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (a rational approximation of the error function)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x) / 2
    return np.where(z > 0, 1 - tail, tail)


class Hashing:
    """tables hashes of `width` projections each; norm: the greatest norm; cell: a cell's share of it."""

    def __init__(self, dims: int, norm: float, tables: int, width: int, cell: float, seed: int = 11):
        dice = np.random.default_rng(seed)
        self.norm, self.cell = norm, cell * norm
        self.lines = dice.normal(size=(tables, dims + 1, width))
        self.shift = dice.uniform(0, self.cell, size=(tables, width))
        self.reach = np.linalg.norm(self.lines, axis=1) / math.sqrt(dims + 1)  # the deviation along each line of what lies at distance 1
        self.moves = np.array(list(product((0, *range(1, REACH + 1), *range(-REACH, 0)), repeat=width)), dtype=np.int8)  # the first stays
        self.tables, self.width = tables, width
        self.large, self.slots = {}, 1

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Cells and places in them, by table, vector and projection."""
        if query:
            x = x * (self.norm / np.linalg.norm(x, axis=1))[:, None]
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return (np.einsum("nd,tdk->tnk", np.column_stack([x, more]), self.lines) + self.shift[:, None]) / self.cell

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Cells (table first, projection last) as longs."""
        key = np.zeros(cells.shape[:-1], dtype=np.uint64)
        for k in range(self.width):
            key = (key ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        t = np.arange(self.tables, dtype=np.uint64).reshape(-1, *[1] * (key.ndim - 1))
        return ((key ^ t) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    def chances(self, places: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """For each perturbation the chance that a vector at a query's distance lies there; by table, query and move. places: in the cells."""
        out = np.zeros((*places.shape[:-1], len(self.moves)))
        for k in range(self.width):
            at = places[..., k : k + 1]
            sigma = np.maximum(1e-9, self.reach[:, k, None, None] * distance[:, None] / self.cell)
            edges = normal_share((np.arange(-REACH, REACH + 2) - at) / sigma)  # of the cells from REACH below to REACH above
            share = np.roll(np.log(np.maximum(1e-30, np.diff(edges, axis=-1))), -REACH, axis=-1)  # by a move of 0, 1, .., -1
            out += share[..., self.moves[:, k]]
        return np.exp(out)

    def visits(self, places: np.ndarray, distance: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Moves in the order of their chances, how many of them each table and query takes, and whether these are enough for each query."""
        share = self.chances(places, distance)
        order = np.argsort(-share, axis=-1, kind="stable")
        total = np.cumsum(np.take_along_axis(share, order, axis=-1), axis=-1)
        wanted = 1 - (1 - chance) ** (1 / self.tables)  # of each table alone
        return order, (total < wanted).sum(axis=-1) + 1, (total[..., -1] >= wanted).all(axis=0)

    def slot(self, keys: np.ndarray, salt) -> np.ndarray:
        mixed = (keys.view(np.uint64) + np.uint64(salt) * np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.uint64(self.slots)).astype(np.int64)


def _matrix(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(scores: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's largest finite scores, with all that tie with the last but for rounding."""
    real = np.isfinite(scores)
    if scores.shape[1] > kept:
        last = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1 : kept]
        real &= scores >= np.where(np.isfinite(last), last - 1e-9 * (1 + np.abs(last)), -np.inf)
    return np.nonzero(real)


def search(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = 2, width: int = 6, cell: float = 2.0, chance: float = 0.95, sample: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding. Rows take no part if the id or the vector is null, the vector is empty, zero or holds null or
    non-finite components. Vectors of different lengths have no product: those of each length are searched apart. A query's own id is
    no candidate of it; ties go to the smaller id; with fewer candidates than k all are returned. Products too large for a double are
    infinite, and still in their order. Repeated rows count once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    share_code(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))
    usable = materialise(usable.distinct(), "vectors")
    is_query = F.col("vec_id") % every == 0
    lengths = sorted(r[0] for r in usable.where(is_query).groupBy(F.size("embedding").alias("n")).count().collect())
    if len(lengths) > 100:
        raise ValueError("queries of over 100 lengths")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        out = out.unionAll(_search(usable.where(F.size("embedding") == n), is_query, n, k, tables, width, cell, chance, sample))
    return out


def _search(usable: DataFrame, is_query, dims: int, k: int, tables: int, width: int, cell: float, chance: float, sample: int) -> DataFrame:
    """search() among usable vectors of one length."""
    spark = usable.sparkSession
    # components are brought below 1 by a power of two, so that no product overflows
    power = math.frexp(usable.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0])[1]
    # one row per distinct vector: its k + 1 least ids, and one of its query ids if it has any
    w = Window.partitionBy("embedding").orderBy("vec_id")
    least = usable.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = usable.where(is_query).groupBy("embedding").agg(F.lit(True).alias("asked"))
    by = [math.ldexp(1.0, power // 2), math.ldexp(1.0, power - power // 2)]  # in two steps, as one may not be a double
    scaled = F.transform("embedding", lambda x: x / by[0] / by[1])
    distinct = least.join(asked, "embedding", "left").select(F.col("ids")[0].alias("id"), scaled.alias("embedding"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    distinct = materialise(distinct, "distinct-vectors")
    n, norm2 = distinct.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).first()
    hashing = Hashing(dims, math.sqrt(norm2), tables, width, cell)
    distinct = spread(distinct)
    some = np.array([r[0] for r in distinct.select("embedding", "id").orderBy(F.xxhash64("id"), "id").limit(sample).collect()], dtype=np.float64)
    near = min(len(some), 1 + -(-k * len(some) // n)) - 1  # the place in the sample of a k-th neighbour, behind the query itself if it is there

    held = spark.sparkContext.broadcast(hashing)

    def index(batches):
        h = held.value
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            keys = h.keys(np.floor(h.project(x, False)))
            for t in range(h.tables):
                yield pa.RecordBatch.from_arrays([pa.array(keys[t]), *b.columns], names=["key", "id", "embedding", "ids"])

    posted = distinct.select("id", "embedding", "ids").mapInArrow(index, "key long, id long, embedding array<double>, ids array<long>")
    # buckets that take more than one slot: MOST of them at most
    large = max(LARGE, n * tables // MOST)
    hashing.large = {r[0]: -(-r[1] // large) for r in posted.groupBy("key").count().where(F.col("count") > large).collect()}
    hashing.slots = max(2 * spark.sparkContext.defaultParallelism, n * tables // SLOT)
    held = spark.sparkContext.broadcast(hashing)
    rows = "slot long, probe boolean, id long, embedding array<double>, ids array<long>, keys array<long>"

    def deal(batches):
        h = held.value
        for b in batches:
            keys, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            salts = np.array([i % h.large.get(key, 1) for key, i in zip(keys.tolist(), ids.tolist())], dtype=np.uint64)
            slots = h.slot(keys, 0)
            for s in np.unique(salts[salts > 0]):
                slots[salts == s] = h.slot(keys[salts == s], s)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.zeros(len(keys), dtype=bool)), *b.columns[1:], pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32)), pa.array(keys))], names=["slot", "probe", "id", "embedding", "ids", "keys"])

    def routed(part, take: list[int], slots: list[np.ndarray], wanted: list[np.ndarray]):
        """Rows of queries: to which slot, and which keys it visits there (none: all)."""
        taken = pa.array(np.array(take, dtype=np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(y) for y in wanted])]).astype(np.int32)
        columns = [pa.array(np.concatenate(slots)), pa.array(np.ones(len(take), dtype=bool)), part.column(0).take(taken), part.column(1).take(taken), pa.nulls(len(take), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(wanted)))], names=["slot", "probe", "id", "embedding", "ids", "keys"])

    def probe(batches):
        h = held.value
        every_slot = np.arange(h.slots)
        for b in batches:
            for at in range(0, len(b.column(0)), 16):  # each with tables * (2 * REACH + 1) ** width chances
                part = b.slice(at, 16)
                x = _slice(part.column(1))
                unit = x * (h.norm / np.linalg.norm(x, axis=1))[:, None]
                product = np.partition(-(unit @ some.T), near, axis=1)[:, near]
                distance = np.sqrt(np.maximum(0.0, 2 * h.norm**2 + 2 * product))
                where = h.project(x, True)
                cells = np.floor(where)
                order, count, enough = h.visits(where - cells, distance, chance)
                take, slots, wanted = [], [], []
                for i in range(len(x)):
                    if not enough[i]:
                        take += [i] * h.slots
                        slots.append(every_slot)
                        wanted += [np.zeros(0, dtype=np.int64)] * h.slots
                        continue
                    own = np.unique(np.concatenate([h.keys(cells[:, i, None] + h.moves[order[t, i, : count[t, i]]])[t] for t in range(h.tables)]))
                    to = h.slot(own, 0)
                    more = [(j, h.slot(own[j : j + 1], s)[0]) for j, key in enumerate(own.tolist()) if key in h.large for s in range(1, h.large[key])] if h.large else []
                    own = np.concatenate([own, own[[j for j, _ in more]]]) if more else own
                    to = np.concatenate([to, [s for _, s in more]]) if more else to
                    sort = np.argsort(to, kind="stable")
                    each, first = np.unique(to[sort], return_index=True)
                    take += [i] * len(each)
                    slots.append(each)
                    wanted += np.split(own[sort], first[1:])
                yield routed(part, take, slots, wanted)

    def everywhere(batches):
        h = held.value
        for b in batches:
            for at in range(0, len(b.column(0)), 64):
                part = b.slice(at, 64)
                m = len(part.column(0))
                yield routed(part, np.repeat(np.arange(m), h.slots).tolist(), [np.arange(h.slots)] * m, [np.zeros(0, dtype=np.int64)] * m * h.slots)

    def scan(batches):
        slot, parts, found = None, [], None
        for b in batches:
            slots, probes = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(slots) != 0) | (np.diff(probes.astype(np.int8)) != 0)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(slots)]):
                if begin == end:
                    continue
                part = b.slice(begin, end - begin)
                if slots[begin] != slot:
                    slot, parts, found = slots[begin], [], None
                if not probes[begin]:
                    parts.append(part)
                    continue
                if found is None:
                    if not parts:
                        continue
                    own = np.concatenate([p.column(5).values.to_numpy()[p.column(5).offsets[0].as_py() :][: len(p)] for p in parts])
                    x, ids = np.concatenate([_slice(p.column(3)) for p in parts]), np.concatenate([p.column(2).to_numpy() for p in parts])
                    found = (own, x, ids, [y for p in parts for y in p.column(4).to_pylist()])
                for at in range(0, len(part), BLOCK):
                    yield from _score(part.slice(at, BLOCK), *found, k)

    posted_rows = posted.mapInArrow(deal, rows)

    def scored(queries: DataFrame) -> DataFrame:
        """query, id, score, ids: of each vector the best places, once."""
        dealt = posted_rows.unionAll(queries).repartition(min(hashing.slots, 20_000), "slot").sortWithinPartitions("slot", "probe")
        near = dealt.mapInArrow(scan, "query long, id long, score double, ids array<long>")
        return near.groupBy("query", "id").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))

    asking = distinct.where("asked").select("id", "embedding")
    best = materialise(scored(asking.mapInArrow(probe, rows)), "found")
    # k + 1 ids, of which one may be the query's own
    enough = best.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k).select(F.col("query").alias("id"))
    short = materialise(asking.join(enough, "id", "left_anti"), "short-queries")
    if not short.isEmpty():
        best = best.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionAll(scored(short.mapInArrow(everywhere, rows)))
    flat = best.select("query", "score", F.explode("ids").alias("vec_id"))
    top = flat.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    named = distinct.where("asked").select(F.col("id").alias("query"), "ids", "embedding").join(lists, "query")
    # by vector, since one may have very many ids
    queries = usable.where(is_query).select(F.col("vec_id").alias("query_id"), scaled.alias("embedding"))
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(named, "embedding").select("query_id", F.posexplode(mine).alias("at", "x"))
    score = F.col("x.score") * by[0] * by[1] * by[0] * by[1]
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), score.alias("score"))


def _slice(column) -> np.ndarray:
    """A list column's rows, which may be part of a longer buffer, as a matrix."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def _score(part, own: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: list, k: int):
    """The nearest vectors of a slot to a block of queries, among those whose key each query probes."""
    kinds, of = np.unique(own, return_inverse=True)
    offsets = part.column(5).offsets.to_numpy()
    keys = part.column(5).values.to_numpy()[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(part)), np.diff(offsets))
    at = np.searchsorted(kinds, keys)
    at[at == len(kinds)] = 0
    hit = kinds[at] == keys
    visits = np.zeros((len(part), len(kinds)), dtype=bool)
    visits[row[hit], at[hit]] = True
    visits[np.diff(offsets) == 0] = True  # no keys: all
    q, asked = _slice(part.column(3)), part.column(2).to_numpy()
    scores = np.where(visits[:, of], q @ x.T, -np.inf)
    i, j = _best(scores, 2 * (k + 1))  # a vector may stand here once per table
    exact = (q[i] * x[j]).sum(axis=1)
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.searchsorted(i, np.arange(len(q)))
    same = np.concatenate([[False], (i[1:] == i[:-1]) & (ids[j[1:]] == ids[j[:-1]])]) if len(i) else np.zeros(0, dtype=bool)
    kept = ~same & (np.arange(len(i)) - first[i] < 2 * (k + 1)) if len(i) else same
    i, j, exact = i[kept], j[kept], exact[kept]
    yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids[j]), pa.array(exact), pa.array([lists[y] for y in j.tolist()], pa.list_(pa.int64()))], names=["query", "id", "score", "ids"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
