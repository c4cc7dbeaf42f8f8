"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

Fingerprints of 64 bits that differ in at most 2 bits differ in at most 2 of their 8 bytes, so they share at least 6 bytes
at the same positions: the guaranteed minimum of matches. Lists of single positional bytes would hold a 256th of the table each,
and pairs would grow with its square; so the index posts each distinct fingerprint under its bytes at 5 positions. The 3
positions left out run through triples that cover each two of the 8 positions: 11 lists. Whichever 2 bytes a pair
differs in, some triple holds both, so the pair meets in that list. What meets only shares 5 bytes for sure; the tally of
all positional bytes that the pair shares is counted, pairs below 6 are dropped, and the others are verified bit by bit.

Only distinct fingerprints are posted, so copies meet nowhere. A long list is not tallied pair by pair: it is divided by each
byte left out (each part has a tally of 6), and a long part, which 16 free bits bound to 65,536 members, probes the 136
ways to change at most 2 of them. A list gives the edges of a spanning forest of its links, not its pairs. Components
come from alternating star contractions, whose hubs are aggregated before their edges are joined to them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, share_code, spread, table

BYTES, BYTES_SHARED, BITS = 8, 6, 2


def _left_out() -> list[tuple[int, ...]]:
    """Triples of byte positions that hold each two positions together at least once, taken greedily."""
    open_pairs, triples = set(combinations(range(BYTES), BITS)), []
    while open_pairs:
        best = max(combinations(range(BYTES), BITS + 1), key=lambda t: len(open_pairs.intersection(combinations(t, BITS))))
        triples.append(best)
        open_pairs.difference_update(combinations(best, BITS))
    return triples


LEFT_OUT = _left_out()
#: The positions that stay, as masks of a signed long.
MASKS = [int(np.array([sum(0xFF << 8 * p for p in range(BYTES) if p not in t)], dtype=np.uint64).view(np.int64)[0]) for t in LEFT_OUT]
#: All ways to change one or two of 16 bits.
FLIPS = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], dtype=np.int64)
SMALL = 64


def fingerprint(text: bytes, words: int) -> int:
    """As a signed long; 0 without words, the hash of all words if they are fewer than a shingle."""
    found = text.lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 65_536):
        h = np.array([digest(x, 42) for x in shingles[at : at + 65_536]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles)).view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (long). Words are runs of what is not ASCII white space, A-Z in lower case. Null text has no words."""
    share_code(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py() or b"", words) for t in texts], pa.int64())], names=["doc_id", "fp"])

    return spread(docs.select("doc_id", "text"), "doc_id", per_core=1).mapInArrow(run, "doc_id long, fp long")


def tallied(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that share at least BYTES_SHARED positional bytes, of a short list."""
    x = members[:, None] ^ members[None, :]
    tally = (x.view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=2)
    return np.nonzero(np.triu(tally >= BYTES_SHARED, 1))


def _probed(members: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within BITS bits, of members that differ at two positions only."""
    own = (members >> 8 * free[0] & 0xFF) | (members >> 8 * free[1] & 0xFF) << 8
    place = np.full(1 << 16, -1, dtype=np.int64)
    place[own] = np.arange(len(members))
    found = [np.stack([i, place[own[i] ^ f]]) for f in FLIPS for i in [np.flatnonzero(place[own ^ f] > np.arange(len(members)))]]
    return tuple(np.concatenate(found, axis=1))


def _links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a list's members that are verified links."""
    if len(members) <= SMALL:
        i, j = tallied(members)
        near = np.bitwise_count((members[i] ^ members[j]).view(np.uint64)) <= BITS
        return i[near], j[near]
    unlike = np.bitwise_or.reduce(members ^ members[0])
    free = [p for p in range(BYTES) if unlike >> 8 * p & 0xFF]
    free += [p for p in range(BYTES) if p not in free][: max(0, 2 - len(free))]
    if len(free) == 2:
        return _probed(members, free)
    found = []
    for p in free:  # what shares one more byte: divide by it
        byte = members >> 8 * p & 0xFF
        order = np.argsort(byte, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
            if len(part) > 1:
                i, j = _links(members[part])
                found.append(np.stack([part[i], part[j]]))
    return tuple(np.concatenate([np.zeros((2, 0), dtype=np.int64), *found], axis=1))


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Each linked member with the first of its component in this list."""
    i, j = _links(members)
    label = np.arange(len(members))
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(members)))
    return list(zip(members[moved].tolist(), members[label[moved]].tolist()))


def link(fps: DataFrame) -> DataFrame:
    """Edges a, b whose components are those of all links between the distinct fingerprints in column fp."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(MASKS)]))
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a small table makes 11 times its rows
    lists = dealt.select("fp", keys.alias("key")).groupBy("key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")

    def run(batches):
        for b in batches:
            edges = [e for x in b.column(0) for e in forest(np.sort(x.values.to_numpy()))]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for all nodes of the edges (a, b) but the roots."""
    now, mark = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"), None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        now = materialise(small, "edges")
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Documents without words (null, empty) have fingerprint zero and are linked like any other. A null doc_id takes part but is
    never a component_id unless its component has no other. Repeated rows stay, each with the same values. An empty table
    gives no rows.
    """
    prints = materialise(fingerprints(docs, words), "fingerprints")
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(link(fps))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
