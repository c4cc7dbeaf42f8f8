"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A window of 10 words holds six 5-grams; its fingerprint is the least of their hashes. A document's fingerprints and the
benchmark's are joined where the least changes from one window to the next, and each hit is extended word by word to both sides.
Equal windows have equal fingerprints at the same place, so every shared span of 10 words or more is found, and each of
its windows is covered by the extension of its own fingerprint. Items of fewer than 10 words are joined by the hash of
all their words; documents are only cut for lengths that occur.

Words are compared by their 64-bit hashes. A-Z is lowered in a Latin-1 view of the UTF-8 bytes: lower() there maps the lead
bytes C3-DE onto E3-FE, and since the number of bytes that follow tells both apart, distinct words stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spread, table

K, WINDOW = 5, 10
GRAMS = WINDOW - K + 1
#: Rows of the benchmark's fingerprints that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: What is between words: ASCII but digits and letters, in the lowered Latin-1 view.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"


def _words(text: str) -> Column:
    """Hashes of a text's words. Null text has none."""
    view = F.lower(F.decode(F.encode(F.col(text), "UTF-8"), "ISO-8859-1"))
    parts = F.filter(F.split(view, BETWEEN), lambda w: w != "")
    return F.coalesce(F.transform(parts, lambda w: F.xxhash64(w)), F.array().cast("array<long>"))


def _n_words(text: str) -> Column:
    """How many words a text has, without lowering it."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), ANY_CASE)
    return (F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)).cast("long")


def _fingerprints(df: DataFrame) -> DataFrame:
    """A row for each place that becomes its window's least 5-gram: its hash fp, its place p (from 0) and around, the words from p-5 to p+9.

    df has words, an array of hashes. around is null beyond the ends. Expressions are kept small: the JVM doesn't compile
    methods of over 8,000 bytes.
    """
    gram = lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(K)])
    rows = df.where(F.size("words") >= WINDOW).withColumn("grams", F.transform(F.sequence(F.lit(0), F.size("words") - K), gram))
    # words p-5 to p+9 are one slice of the padded array
    pad = F.lit(None).cast("long")
    rows = rows.withColumn("padded", F.concat(F.array_repeat(pad, WINDOW - K), F.col("words"), F.array_repeat(pad, WINDOW - K))).drop("words")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("grams") - (GRAMS - 1))))
    rows = rows.withColumn("fp", F.array_min(F.slice("grams", F.col("i"), GRAMS)))
    # the least changes where a gram that left was as small, or the one that came is the least
    left, came = F.get("grams", F.col("i") - 2), F.get("grams", F.col("i") + (GRAMS - 2))
    rows = rows.where((F.col("i") == 1) | (left <= F.col("fp")) | (came == F.col("fp")))
    p = F.col("i") + F.array_position(F.slice("grams", F.col("i"), GRAMS), F.col("fp")) - 2
    rows = rows.withColumn("p", p.cast("int")).drop("grams", "i")
    return rows.withColumn("around", F.slice("padded", F.col("p") + 1, 2 * WINDOW - K)).drop("padded")


def _run(agree: Column) -> Column:
    """How many agree from the first on."""
    first = F.array_position(agree, F.lit(False))
    return F.when(first == 0, F.size(agree)).otherwise(first - 1).cast("int")


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence of an item's window), n_items, items (sorted as strings), contaminated.

    docs: doc_id, text; items: item_id, text. Null and empty texts have no words and hit nothing. Repeated rows each get their
    row. An empty benchmark hits nothing. Items that share a window count each.
    """
    key = ["doc_id", "key"]
    docs = spread(docs.select("doc_id", "text"), "doc_id", per_core=1).withColumn("key", F.xxhash64("doc_id", "text"))
    own = docs.select(*key, _words("text").alias("words"))
    theirs = materialise(items.select("item_id", _words("text").alias("words")).where(F.size("words") > 0), "items")
    long = materialise(_fingerprints(theirs).select("fp", "item_id", F.col("around").alias("theirs")).distinct(), "item-fingerprints")
    found = _fingerprints(own).join(_maybe_broadcast(long), "fp")
    found = found.withColumn("agree", F.zip_with("around", "theirs", lambda a, b: F.coalesce(a == b, F.lit(False))))
    side = WINDOW - K
    found = found.withColumns({"left": _run(F.reverse(F.slice("agree", 1, side))), "middle": _run(F.slice("agree", side + 1, K)), "right": _run(F.slice("agree", side + K + 1, side))})
    found = found.where((F.col("middle") == K) & (F.col("left") + K + F.col("right") >= WINDOW))
    hits = found.select(*key, "item_id", (F.col("p") - F.col("left")).alias("begin"), (F.col("p") + K + F.col("right")).alias("end"))
    lengths = [r[0] for r in theirs.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect()]  # at most 9
    for n in sorted(lengths):
        short = theirs.where(F.size("words") == n).select("item_id", F.xxhash64("words").alias("fp"), F.col("words").alias("theirs"))
        cut = own.where(F.size("words") >= n).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - n)))
        cut = cut.withColumn("cut", F.array(*[F.get("words", F.col("i") + j) for j in range(n)])).select(*key, "i", "cut", F.xxhash64("cut").alias("fp"))
        same = cut.join(_maybe_broadcast(short), "fp").where(F.col("cut") == F.col("theirs"))
        hits = hits.unionAll(same.select(*key, "item_id", F.col("i").alias("begin"), (F.col("i") + n).alias("end")))
    # spans of a document, united: (words covered, end so far) over spans by begin
    spans = F.array_sort(F.collect_set(F.struct("begin", "end")))
    grouped = hits.groupBy(*key).agg(spans.alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    unite = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["begin"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
    )["n"]
    grouped = grouped.select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), unite.cast("long").alias("n_hit"), "items")
    counts = docs.select(*key, _n_words("text").alias("n_words"))
    joined = counts.join(grouped, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
