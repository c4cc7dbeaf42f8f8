"""Ranked lexical search over a tiered index.

A posting is a term in a document with its impact, an integer that grows with the term's share of the document. Each term's postings
are dealt over tiers by impact, the highest first: tier 0 holds about `first` of them, each further tier `growth` times as
many. Of what lies below a tier only the greatest impact is known, the term's residual.

An item starts with tier 0 of all its terms. Documents met there have a part of their score; what is missing of a document is
at most the residuals of the terms it wasn't met under, and a document not met at all has at most the sum of all residuals. If that sum
is below the k-th of the scores that the best documents met so far have by the forward table, the answer is among the documents met, and
those that can still reach it are scored exactly. Items without this proof fall through: their terms go one tier down, but for those whose
residuals together stay below the k-th score, which can't bring in a new document. In the last tier residuals are zero, so every item ends.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, share_code, spread, table

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of items that are searched together, counted once an item: they are known to each task. More items go in groups.
MOST_TERMS = 500_000
#: Rows that may be broadcast.
BROADCAST_ROWS = 300_000
#: Impacts are below a million; a level is this many of them.
LEVEL = 4096


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def forward(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """row, doc_id, n, terms, tfs: of each document with a term its key, how many terms it has, and the wanted ones by place in `wanted`, ascending, with how often each occurs. Written once."""
    spark = docs.sparkSession
    share_code(spark)
    sent = spark.sparkContext.broadcast({t.encode(): i for i, t in enumerate(wanted)})

    def run(batches):
        word, place = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), sent.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                ids, ns, terms, tfs = [], [], [], []
                for k, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    if text and (found := word.findall(text.lower())):
                        ids.append(k)
                        ns.append(len(found))
                        counts = sorted(Counter(place[t] for t in found if t in place).items())
                        terms.append([t for t, _ in counts])
                        tfs.append([n for _, n in counts])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (terms, tfs))], names=["doc_id", "n", "terms", "tfs"])

    cut = spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")
    return materialise(cut.withColumn("row", F.monotonically_increasing_id()), "forward")


def _tiers(hist: DataFrame, first: int, growth: int) -> DataFrame:
    """term, df, floors (the lowest level of each tier), rest (the greatest impact below each tier) of a histogram term, level, c, top.

    A term has as many rows as there are levels, 245 at most.
    """

    def run(batches):
        for b in batches:
            out = []
            for levels in b.column(1).to_pylist():
                n, floors, rest = 0, [], []
                for x in sorted(levels, key=lambda x: -x["level"]):
                    n += x["c"]
                    tier = 0 if n <= first else math.ceil(math.log(n / first) / math.log(growth) - 1e-12)
                    rest += [x["top"]] * (tier - len(rest))  # of the tiers that end above this level
                    while len(floors) < tier:
                        floors.append(floors[-1] if floors else 1 << 20)
                    if len(floors) == tier:
                        floors.append(x["level"])
                    floors[tier] = x["level"]
                out.append((n, floors, [*rest, *[0] * (len(floors) - len(rest))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), *[pa.array([x[i] for x in out], pa.list_(pa.int64())) for i in (1, 2)]], names=["term", "df", "floors", "rest"])

    lists = hist.groupBy("term").agg(F.collect_list(F.struct("level", "c", "top")).alias("levels"))
    return lists.mapInArrow(run, "term long, df long, floors array<long>, rest array<long>")


def search(docs: DataFrame, items: DataFrame, k: int = 50, first: int = 256, growth: int = 16) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 of each item, ties to the smaller doc_id.

    docs: doc_id, text; items: item_id, text. Null and empty texts have no terms: such documents are not counted, such items get no rows.
    Rows that share an item_id, null or not, are one item of all their terms. Repeated documents are documents of their own; a null
    doc_id comes after all others, and documents with equal ids and scores are interchangeable. Empty tables give no rows.
    """
    return ranked(docs, items, k, first, growth)[0]


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, first: int = 256, growth: int = 16) -> tuple[DataFrame, list[int]]:
    """The rows of search(), and how many items each depth proved."""
    spark = docs.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), 0))
    asked = items.select("item_id", F.explode(terms).alias("word")).distinct()
    keys = materialise(asked.groupBy("item_id").agg(F.count("*").alias("c")).withColumn("item", F.monotonically_increasing_id()), "items")
    groups = -(-(keys.agg(F.sum("c")).first()[0] or 0) // MOST_TERMS)
    asked = asked.alias("x").join(keys.alias("y"), F.expr("x.item_id <=> y.item_id")).select("item", "word")
    asked = materialise(asked.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(max(1, groups)))), "item-terms")
    top, proved = spark.createDataFrame([], "item long, rank int, doc_id long, score long"), []
    for g in range(groups):
        found, own = _ranked(docs, asked.where(F.col("group") == g).select("item", "word"), k, first, growth)
        top = top.unionAll(found)
        proved = [sum(x) for x in zip_longest(proved, own, fillvalue=0)]
    return top.join(keys.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), proved


def _ranked(docs: DataFrame, asked: DataFrame, k: int, first: int, growth: int) -> tuple[DataFrame, list[int]]:
    """item, rank, doc_id, score of one group of items (item, word), and how many of them each depth proved."""
    spark = docs.sparkSession
    wanted = sorted(r[0] for r in asked.select("word").distinct().collect())  # MOST_TERMS, or about
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(wanted)), "term long, word string"))
    ahead = forward(docs, wanted)
    n_docs, n_terms, longest = ahead.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    out = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    if not n_docs:
        return out, []
    share = f"(50 * n * {n_docs}L) div {n_terms}L" if 50 * longest * n_docs < 1 << 62 else f"CAST((CAST(50 AS DECIMAL(38, 0)) * n * {n_docs}L) div {n_terms}L AS BIGINT)"
    impact = "(1000000000L * {0}) div (1000L * {0} + 20L * m)"
    measured = ahead.withColumn("m", F.expr(f"50 + {share}"))
    one = F.explode(F.arrays_zip("terms", "tfs")).alias("x")
    postings = measured.select("row", "m", one).select("row", F.col("x.terms").alias("term"), F.expr(impact.format("x.tfs")).alias("s"))
    level = F.expr(f"s div {LEVEL}")
    tiers = _tiers(postings.groupBy("term", level.alias("level")).agg(F.count("*").alias("c"), F.max("s").alias("top")), first, growth)
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    words = materialise(tiers.select("term", weight.alias("w"), "floors", "rest"), "dictionary")
    dealt = postings.join(_maybe_broadcast(words.select("term", "floors")), "term")
    index = materialise(dealt.select("term", "row", "s", F.size(F.filter("floors", lambda f: f > level)).alias("tier")), "index", "tier")
    needs = materialise(asked.join(numbers, "word").join(words, "term").where("w > 0").select("item", "term", "w", "rest", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("least")), "needs")
    depth, proved = 0, []
    while needs.limit(1).count():
        now = needs.withColumn("left", F.col("w") * F.coalesce(F.get("rest", "depth"), F.lit(0)))
        unmet = now.groupBy("item").agg(F.sum("left").alias("unmet"), F.max("least").alias("least"))
        gain = F.col("w") * F.col("s")
        met = index.where(F.col("tier") <= depth).join(_maybe_broadcast(now), "term").where("tier <= depth")
        met = met.groupBy("item", "row").agg(F.sum(gain).alias("part"), F.sum("left").alias("known"), F.sum(F.when(F.col("left") == 0, gain).otherwise(0)).alias("done"))
        # the k-th score of the tiers before is a bound already
        met = met.join(_maybe_broadcast(unmet), "item").withColumn("most", F.col("part") + F.col("unmet") - F.col("known")).where(F.col("most") >= F.col("least"))
        met = materialise(met.select("item", "row", "part", "done", "most"), "met")
        # the exact scores of the k best so far: the k-th of them is a bound for all
        best = met.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part"), "row"))).where(F.col("r") <= k)
        sure = materialise(_scored(measured, materialise(best.select("item", "row", "done"), "best"), now, len(wanted)), "sure")
        kth = sure.groupBy("item").agg(F.count("*").alias("c"), F.min("score").alias("last")).select("item", F.when(F.col("c") == k, F.col("last")).otherwise(0).alias("last"))
        state = unmet.join(kth, "item", "left").select("item", "unmet", F.greatest("least", F.coalesce("last", F.lit(0))).alias("least"))
        state = materialise(state.withColumn("proof", (F.col("unmet") == 0) | (F.col("unmet") < F.col("least"))), "proof")
        proven = state.where("proof").select("item", "least")
        hopeful = met.join(_maybe_broadcast(proven), "item").where(F.col("most") >= F.col("least"))
        scores = _scored(measured, materialise(hopeful.select("item", "row", "done"), "candidates"), now, len(wanted))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
        out = out.unionAll(materialise(scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score"), "ranked"))
        proved.append(proven.count())
        # terms that together stay below the k-th score need not go deeper
        open_ = now.join(_maybe_broadcast(state.where("not proof").select("item", F.col("least").alias("bound"))), "item")
        small = F.sum("left").over(Window.partitionBy("item").orderBy("left", "term")) < F.col("bound")
        needs = materialise(open_.select("item", "term", "w", "rest", F.when(small, F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"), F.col("bound").alias("least")), "needs")
        depth += 1
    return out, proved


def _scored(measured: DataFrame, pairs: DataFrame, now: DataFrame, n_terms: int) -> DataFrame:
    """item, row, doc_id, score above 0 of pairs item, row, done: what terms without residual give is done, the others are looked up in the forward table."""
    lists = now.where("left > 0").select("item", "term", "w").orderBy("item").toArrow()
    item, first = np.unique(lists["item"].to_numpy(), return_index=True)
    sent = measured.sparkSession.sparkContext.broadcast((item, np.append(first, len(lists)), lists["term"].to_numpy(), lists["w"].to_numpy()))

    def flat(column) -> tuple[np.ndarray, np.ndarray]:
        """A list column's values, and the row of each."""
        offsets = column.offsets.to_numpy()
        return column.values.slice(offsets[0], offsets[-1] - offsets[0]), np.repeat(np.arange(len(column)), np.diff(offsets))

    def run(batches):
        items, begins, terms, weights = sent.value
        for b in batches:
            if not len(b):
                continue
            held, of = flat(b.column(3))
            own = np.append(of * n_terms + held.to_numpy(), np.iinfo(np.int64).max)
            tf, m = flat(b.column(4))[0].to_numpy(), b.column(2).to_numpy()[of]
            s = np.append(10**9 * tf // (1000 * tf + 20 * m), 0)
            asked, row = flat(b.column(5))
            asked, score = asked.field("item").to_numpy(), asked.field("done").to_numpy().copy()
            at = np.searchsorted(items, asked)
            at[at == len(items)] = 0
            counts = np.where(items[at] == asked, begins[at + 1] - begins[at], 0) if len(items) else np.zeros(len(asked), dtype=np.int64)
            pair = np.repeat(np.arange(len(asked)), counts)
            term = np.repeat(begins[at] - np.cumsum(counts) + counts, counts) + np.arange(len(pair)) if len(items) else pair
            key = row[pair] * n_terms + terms[term]
            place = np.searchsorted(own, key)
            np.add.at(score, pair, np.where(own[place] == key, weights[term] * s[place], 0))
            real = score > 0
            yield pa.RecordBatch.from_arrays([pa.array(asked[real]), *(b.column(i).take(pa.array(row[real])) for i in (0, 1)), pa.array(score[real])], names=["item", "row", "doc_id", "score"])

    grouped = pairs.groupBy("row").agg(F.collect_list(F.struct("item", "done")).alias("pairs"))
    looked = measured.join(F.broadcast(grouped) if pairs.count() <= BROADCAST_ROWS else grouped, "row").select("row", "doc_id", "m", "terms", "tfs", "pairs")
    return looked.mapInArrow(run, "item long, row long, doc_id long, score long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
