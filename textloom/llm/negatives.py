"""Hard negatives by bit-sliced integer products.

Components become integers and, moved by a power of two, numbers without sign; bit p of all components of a vector is its plane p. The product
of an anchor with a vector is the sum of its products with the planes, each times 2^p. After the planes down to p, what is left
of a component is between 0 and 2^p - 1, so the score lies in an interval: the sum so far plus that range times the anchor's negative
components, and times its positive ones. Planes are taken most significant first. Whenever the intervals are narrow
enough, candidates are dropped that cannot qualify: for positives, those whose interval ends below the anchor's last place so far; for
negatives, those outside all of the anchor's windows, or below the last place of each. The planes that are left
are taken for surviving pairs alone; at plane 0 the interval is the score.

Anchors go in groups of bounded size to all tasks; vectors stay where they are and are read once a group. A task keeps for each
anchor no more rows than are wanted of it, and only these meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, share_code, spread, table

#: Components of a group's anchors together, and anchors and vectors that are compared at once.
GROUP, ANCHORS, BLOCK = 4_000_000, 256, 2048
#: Pairs are taken one by one as soon as this share of a block is left.
SPARSE = 0.1


class Planes:
    """How components become planes: `bits` of them, after moving by 2^(bits - 1)."""

    def __init__(self, low: int, high: int):
        self.bits = max(int(-low - 1).bit_length(), int(high).bit_length()) + 1
        self.moved = 1 << (self.bits - 1)

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Planes (most significant first) of integer vectors, as 0 and 1: plane, component, vector."""
        up = (x + self.moved).T
        return np.stack([(up >> p & 1).astype(np.float64) for p in range(self.bits - 1, -1, -1)])


def survivors(anchors: np.ndarray, planes: np.ndarray, moved: int, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the pairs that `keep` never drops.

    keep(i, j, low, high) says of pairs whose score lies between low and high, ends included, which may still qualify; i and j
    are None for a whole block, else the pairs' places. alive: the pairs that take part.
    """
    bits = len(planes)
    below, above = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
    total = np.repeat((-moved * anchors.sum(axis=1))[:, None], planes.shape[2], axis=1)
    size, at = alive.size, 0
    while at < bits:
        p = bits - 1 - at
        total += (1 << p) * (anchors @ planes[at])
        at += 1
        rest = (1 << p) - 1
        if rest * (above - below).max() < 2 * np.ptp(total) or not p:  # intervals that are narrower than what scores span can tell
            alive &= keep(None, None, total + rest * below[:, None], total + rest * above[:, None])
            if np.count_nonzero(alive) <= SPARSE * size:
                break
    i, j = np.nonzero(alive)
    scores = total[i, j]
    for at in range(at, bits):
        if not len(i):
            break
        p = bits - 1 - at
        plane = planes[at].T
        for b in range(0, len(i), 65_536):
            scores[b : b + 65_536] += (1 << p) * (anchors[i[b : b + 65_536]] * plane[j[b : b + 65_536]]).sum(axis=1)
        rest = (1 << p) - 1
        left = keep(i, j, scores + rest * below[i], scores + rest * above[i])
        i, j, scores = i[left], j[left], scores[left]
    return i, j, scores.astype(np.int64)


class Best:
    """The k best (score, then smaller id) of each of n places."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.score, self.id = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)

    def last(self, of) -> np.ndarray:
        return self.score[of, -1].astype(np.float64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        at, scores, ids = at[kept], scores[kept], ids[kept]
        places, first = np.unique(at, return_index=True)
        more = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
        both = [np.concatenate([own[places], np.full((len(places), self.k), fill)], axis=1) for own, fill in ((self.score, np.iinfo(np.int64).min), (self.id, np.iinfo(np.int64).max))]
        row = np.searchsorted(places, at)
        both[0][row, self.k + more], both[1][row, self.k + more] = scores, ids
        order = np.lexsort((both[1], -both[0].astype(np.float64)), axis=1)[:, : self.k]
        self.score[places], self.id[places] = np.take_along_axis(both[0], order, 1), np.take_along_axis(both[1], order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, scores and ids of what was found."""
        i, j = np.nonzero(self.id < np.iinfo(np.int64).max)
        return i, self.score[i, j], self.id[i, j]


def _vectors(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_id, label, components (vec_id, label, q) as arrays."""
    q = batch.column(2)
    offsets = q.offsets.to_numpy()
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), q.values.to_numpy()[offsets[0] : offsets[-1]].reshape(len(batch), -1)


def _blocks(batches):
    for b in batches:
        for at in range(0, len(b), BLOCK):
            if len(part := b.slice(at, BLOCK)):
                yield _vectors(part)


def closest_of_label(vectors: DataFrame, group, planes: Planes, k: int) -> DataFrame:
    """anchor, score, vec_id: of each anchor's place in the group (a broadcast of ids, labels, components) the best rows of its label, by task."""

    def run(batches):
        ids, labels, q = group.value
        best = Best(len(ids), k)
        for own, kinds, x in _blocks(batches):
            for label in np.unique(kinds):
                mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(kinds == label)
                cut = planes.cut(x[theirs]) if len(mine) else None
                for at in range(0, len(mine), ANCHORS):
                    block = mine[at : at + ANCHORS]
                    last, others = best.last(block), ids[block][:, None] != own[theirs][None, :]

                    def keep(i, j, low, high):
                        if i is not None:
                            return high >= last[i]
                        bound = last
                        if high.shape[1] > k:
                            bound = np.maximum(bound, np.partition(np.where(others, low, -np.inf), -k, axis=1)[:, -k])
                        return high >= bound[:, None]

                    i, j, scores = survivors(q[block], cut, planes.moved, others.copy(), keep)
                    best.add(block[i], scores, own[theirs][j])
        place, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(score), pa.array(found)], names=["anchor", "score", "vec_id"])

    return vectors.mapInArrow(run, "anchor long, score long, vec_id long")


def inside_windows(vectors: DataFrame, group, planes: Planes, windows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> DataFrame:
    """window, score, vec_id: of each window the best rows of another label than its anchor's with a score inside, by task.

    windows: places of anchors in the group, ascending, and the least and greatest score wanted.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        ids, labels, q = group.value
        anchor, least, greatest = sent.value
        best = Best(len(anchor), k)
        used, first = np.unique(anchor, return_index=True)
        ends = np.append(first, len(anchor))[1:]
        for own, kinds, x in _blocks(batches) if len(used) else ():
            cut = planes.cut(x)
            for at in range(0, len(used), ANCHORS):
                block, begin, end = used[at : at + ANCHORS], first[at : at + ANCHORS], ends[at : at + ANCHORS]
                bottom = np.minimum.reduceat(np.maximum(least, best.last(slice(None)))[begin[0] : end[-1]], begin - begin[0])
                top = np.maximum.reduceat(greatest[begin[0] : end[-1]], begin - begin[0])

                def keep(i, j, low, high):
                    return (high >= bottom[:, None]) & (low <= top[:, None]) if i is None else (high >= bottom[i]) & (low <= top[i])

                i, j, scores = survivors(q[block], cut, planes.moved, labels[block][:, None] != kinds[None, :], keep)
                for n in range(int((end - begin).max(initial=0))):
                    w = begin[i] + n
                    inside = w < end[i]
                    w, js, s = w[inside], j[inside], scores[inside]
                    inside = (s >= least[w]) & (s <= greatest[w])
                    best.add(w[inside], s[inside], own[js[inside]])
        place, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(score), pa.array(found)], names=["window", "score", "vec_id"])

    return vectors.mapInArrow(run, "window long, score long, vec_id long")


def _first(found: DataFrame, of: str, k: int) -> DataFrame:
    """The k best of each place over all tasks, with their rank."""
    order = Window.partitionBy(of).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, scale: int = 256, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. Anchors are the rows whose vec_id is divisible by `every`; a component x counts as floor(scale x). An anchor's positives
    are its best other rows of the same label; for each, the best rows of other labels whose score is from `low` to `high` percent of the
    positive's. A positive without such rows has none, so one of negative score has none.

    Rows take no part if id, label or vector is null, or a component is null or not finite, or so large that a product might not fit in
    a long. Vectors of different lengths have no product: those of each length are mined apart. Equal rows count once; rows that share an id are
    candidates of their own, never of an anchor with that id. Ties go to the smaller id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    share_code(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    typed = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    usable = typed.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite)
    fits = F.forall("embedding", lambda x: F.abs(x) * scale * F.sqrt(F.size("embedding")) < float(1 << 25))
    usable = usable.where(fits).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x)).alias("q"))
    usable = spread(materialise(usable.distinct(), "integers"))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    shapes = usable.where(F.col("vec_id") % every == 0).groupBy(F.size("q").alias("dims")).agg(F.count("*").alias("n")).collect()
    if len(shapes) > 100:
        raise ValueError("anchors of over 100 lengths")
    for dims, n in sorted(tuple(r) for r in shapes):
        own = usable.where(F.size("q") == dims)
        least, greatest = own.agg(F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
        planes = Planes(least, greatest)
        groups = -(-n * dims // GROUP)
        anchors = own.where(F.col("vec_id") % every == 0).withColumn("group", F.pmod(F.xxhash64("vec_id", "q"), F.lit(groups)))
        for g in range(groups):
            out = out.unionAll(_mined(own, anchors.where(F.col("group") == g), planes, positives, negatives, low, high))
    return out


def _mined(own: DataFrame, anchors: DataFrame, planes: Planes, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """mine() for one group of anchors, of GROUP components or about."""
    spark = own.sparkSession
    held = anchors.select("vec_id", "label", "q").orderBy("vec_id", "label", "q").toArrow().combine_chunks()
    ids, labels, q = _vectors(held.to_batches()[0]) if len(held) else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros((0, 1), dtype=np.int64),)
    q = q.astype(np.float64)
    group = spark.sparkContext.broadcast((ids, labels, q))
    near = _first(closest_of_label(own, group, planes, positives), "anchor", positives).select("anchor", "rank", "vec_id", "score")
    near = sorted(tuple(r) for r in near.collect())  # as many as the group has anchors, times `positives`
    anchor, score = np.array([r[0] for r in near], dtype=np.int64), np.array([r[3] for r in near], dtype=np.int64)
    windows = anchor, -(-low * score // 100), high * score // 100
    found = materialise(inside_windows(own, group, planes, windows, negatives), "negatives")
    named = spark.createDataFrame([(w, int(ids[a]), p, s) for w, (a, _, p, s) in enumerate(near)], "window long, anchor_id long, positive_id long, positive_score long")
    best = _first(found, "window", negatives).withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id")
    return materialise(best.join(named, "window").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return mine(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select("vec_id", "embedding", label))
