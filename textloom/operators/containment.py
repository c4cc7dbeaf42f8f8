"""Which of many wanted words stand inside known ones, in one pass over the known words, whatever the words' lengths."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wanted words, and characters of them, that go to every task as an automaton; of more, each known word's endings meet the wanted words that begin alike.
MOST_WORDS, MOST_CHARACTERS, PREFIX = 200_000, 4_000_000, 6


def contained(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """word: the wanted words (word) that some known word (word) holds, be it as a whole. Null and empty words are held by none, and hold nothing."""
    wanted = wanted.select("word").where("word <> ''").distinct()
    known = known.select("word").where("word <> ''")
    n, characters, shortest = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0)), F.coalesce(F.min(F.length("word")), F.lit(1))).first()
    if n > MOST_WORDS or characters > MOST_CHARACTERS:
        return _by_prefix(wanted, known, min(shortest, PREFIX))
    sent = known.sparkSession.sparkContext.broadcast([r[0] for r in wanted.collect()])

    def run(batches):
        machine = ahocorasick.Automaton()
        for w in sent.value:
            machine.add_word(w, w)
        machine.make_automaton()
        said: set[str] = set()
        for b in batches:
            found = {w for x in b.column(0).to_pylist() for _, w in machine.iter(x)} - said if sent.value else set()
            said |= found
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    return known.mapInArrow(run, "word string").distinct()


def _by_prefix(wanted: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """contained() as one join: on the first `width` characters of wanted words and of all endings of known ones."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - (width - 1)))
    endings = known.where(F.length("word") >= width).distinct().select("word", at.alias("at")).select(F.expr("substring(word, at)").alias("ending"))
    endings = endings.select("ending", F.substring("ending", 1, width).alias("prefix"))
    met = endings.join(wanted.withColumn("prefix", F.substring("word", 1, width)), "prefix").where(F.startswith("ending", F.col("word")))
    return met.select("word").distinct()
