"""Vocabularies and token streams: validity, files, ids with guards, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from ..sources import files
from .scan import sums_before

#: Stands before each text of a stream.
START = "<|start|>"


def vocabulary(chars: list[str], merges: list[tuple[str, str]]) -> list[str]:
    """Tokens by id: characters, merged pieces in learning order, START. Refuses what can't be told apart."""
    if chars != sorted(set(chars)) or any(len(c) != 1 for c in chars):
        raise ValueError("characters must be single, distinct and sorted")
    if not set(START) - set(chars):
        raise ValueError("the alphabet can spell START")
    tokens = [*chars, *(a + b for a, b in merges), START]
    if len(set(tokens)) < len(tokens):
        raise ValueError("two entries are one string")
    return tokens


def prefix(chars: list[str], merges: list[tuple[str, str]], size: int) -> list[tuple[str, str]]:
    """The merges of a vocabulary of `size` entries: a smaller one's are the first of a larger one's."""
    wanted = size - len(chars) - 1
    if not 0 <= wanted <= len(merges):
        raise ValueError(f"no vocabulary of {size} entries: {len(chars)} characters, {len(merges)} merges")
    return merges[:wanted]


def save(spark: SparkSession, path: str, chars: list[str], merges: list[tuple[str, str]], fitted_on: dict) -> None:
    tokens = vocabulary(chars, merges)
    held = {"kind": "bpe" if merges else "char", "vocab_size": len(tokens), "start_token": START, "start_id": len(tokens) - 1, "fitted_on": fitted_on, "chars": chars, "merges": [list(m) for m in merges]}
    files.put(spark, path, json.dumps(held, ensure_ascii=False, indent=1) + "\n")


def load(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Characters and merges of a tokenizer file; an error where it does not build what it says."""
    held = json.loads(spark.read.text(path, wholetext=True).first()[0])
    chars, merges = held["chars"], [tuple(m) for m in held["merges"]]
    if held["kind"] != ("bpe" if merges else "char") and not (held["kind"] == "bpe" and not merges):
        raise ValueError(f"{path}: not a tokenizer of a known kind")
    tokens = vocabulary(chars, merges)
    if (held["start_token"], held["start_id"], held["vocab_size"]) != (START, len(tokens) - 1, len(tokens)):
        raise ValueError(f"{path}: START or the size is not what the file builds")
    return chars, merges


def ids_of(token: Column, ids: Column) -> Column:
    """A token's id in a map; an error for one that the vocabulary lacks."""
    return F.coalesce(F.element_at(ids, token), F.raise_error(F.concat(F.lit("not in the vocabulary: "), token)))


def token_of(id_: Column, tokens: Column) -> Column:
    """An id's token in a map; an error for an id that the vocabulary lacks, a negative one for example."""
    return F.coalesce(F.element_at(tokens, id_), F.raise_error(F.concat(F.lit("no such id: "), id_.cast("string"))))


def tokens_of(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ch to rows with an id; an error for an id that the vocabulary (ch, id) lacks, a negative one for example."""
    known = F.broadcast(vocab.select("id", "ch"))  # an alphabet
    wrong = F.raise_error(F.concat(F.lit("no such id: "), F.col("id").cast("string")))
    return ids.join(known, "id", "left").withColumn("ch", F.coalesce("ch", wrong))


def write_stream(tokens: DataFrame, start_id: int, path: str) -> None:
    """A token stream as files: doc_id, pos, token_id of each text, START at 0."""
    starts = tokens.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("pos"), F.lit(start_id).alias("token_id"))
    rows = starts.unionAll(tokens.select("doc_id", (F.col("pos") + 1).cast("long"), F.col("token_id").cast("int")))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "pos").write.parquet(path)


def read_stream(spark: SparkSession, path: str, start_id: int) -> DataFrame:
    """doc_id, pos, token_id; an error where a text does not begin with START."""
    rows = spark.read.schema("doc_id long, pos long, token_id int").parquet(path)
    first = F.when((F.col("pos") == 0) & (F.col("token_id") != start_id), F.raise_error(F.concat(F.lit("no START before "), F.col("doc_id").cast("string"))))
    return rows.withColumn("token_id", F.coalesce(first, "token_id"))


def usage(used: DataFrame, vocab: list[str]) -> DataFrame:
    """One row: entries, and how many were used 100 times or more, under 10 times, never. used: token, n."""
    entries = used.sparkSession.createDataFrame([(t,) for t in vocab if t != START], "token string")
    n = F.coalesce("n", F.lit(0))
    return entries.join(used, "token", "left").agg(F.count("*").alias("tokens"), F.count_if(n >= 100).alias("often"), F.count_if((n < 10) & (n > 0)).alias("seldom"), F.count_if(n == 0).alias("never"))


def meeting(spans: DataFrame, others: DataFrame, key: str, block: int = 64) -> DataFrame:
    """Pairs of spans (key, begin, end and more) and others (key, o_begin, o_end and more) of the same text that overlap.

    A join on the blocks of `block` characters that both touch; a pair is taken where it first meets, so once.
    """
    of = lambda b, e: F.explode(F.sequence(F.floor(F.col(b) / block), F.floor((F.col(e) - 1) / block)))
    left, right = spans.where("end > begin").withColumn("block", of("begin", "end")), others.where("o_end > o_begin").withColumn("block", of("o_begin", "o_end"))
    first = F.floor(F.greatest("begin", "o_begin") / block) == F.col("block")
    return left.join(right, [key, "block"]).where((F.col("begin") < F.col("o_end")) & (F.col("o_begin") < F.col("end")) & first).drop("block")


def placed(pieces: DataFrame, key: str, text: str) -> DataFrame:
    """Adds o_begin and o_end, where each piece (column `text`, in the order of pos) stands in its text."""
    numbered = isinstance(pieces.schema["pos"].dataType, (IntegerType, LongType))
    if numbered:
        return sums_before(pieces, key, "pos", F.length(text), "o_begin").withColumn("o_end", F.col("o_begin") + F.length(text))
    end = F.sum(F.length(text)).over(Window.partitionBy(key).orderBy("pos"))
    return pieces.withColumn("o_end", end).withColumn("o_begin", F.col("o_end") - F.length(text))


def words_in(docs: DataFrame, key: str, letters: str = r"\p{L}") -> DataFrame:
    """key, word, begin, end of each run of letters."""
    runs = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(f"[{letters}]+|[^{letters}]+"), 0)).alias("pos", "word"))
    return placed(runs, key, "word").where(F.regexp_like("word", F.lit(f"^[{letters}]"))).select(key, "word", F.col("o_begin").alias("begin"), F.col("o_end").alias("end"))


def ways_to_cut(words: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """word, occurrences, ways: the different sequences of tokens (token, o_begin, o_end) that cover an occurrence."""
    covering = meeting(words, tokens, key).groupBy(key, "begin", "word").agg(F.array_sort(F.collect_list(F.struct("o_begin", "token"))).alias("found"))
    cut = F.array_join(F.transform("found", lambda x: x["token"]), "|")
    return covering.groupBy("word", cut.alias("cut")).agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("occurrences"), F.count("*").alias("ways"))


def shared_bits(tokens: DataFrame, key: str) -> DataFrame:
    """key, at, bits: each token's bits in equal parts on its characters (o_begin, o_end); those of a token of no character on the one behind it."""
    each = tokens.where("o_end > o_begin").select(key, F.explode(F.sequence(F.col("o_begin"), F.col("o_end") - 1)).alias("at"), (F.col("bits") / (F.col("o_end") - F.col("o_begin"))).alias("bits"))
    return each.unionAll(tokens.where("o_end = o_begin").select(key, F.col("o_begin").alias("at"), "bits")).groupBy(key, "at").agg(F.sum("bits").alias("bits"))
