"""Queries over vocabularies and token streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import characters, chunks
from ..operators import bpe, vocabulary
from ..sources import corpus, files
from .registry import D, chars_sql, chunks_sql, query

SIZES = (256, 512, 1024, 2048)


def _alphabet(df: DataFrame) -> list[str]:
    """Characters in code-point order: an alphabet."""
    return sorted(r[0] for r in df.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct().collect())


WORDS = rf"""{D}, v AS (SELECT doc_id, text FROM d WHERE "set" = 'validation'), {chars_sql('c', 'v', 'doc_id')}, l AS (SELECT doc_id, pos, ch, regexp_matches(ch, '\p{{L}}') AS is_letter FROM c), i AS (SELECT doc_id, pos, ch, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l WHERE is_letter),
    w AS (SELECT doc_id, min(pos)::BIGINT AS b, max(pos)::BIGINT + 1 AS e, string_agg(ch, '' ORDER BY pos) AS word FROM i GROUP BY doc_id, island)"""


@query("q_word_spans", f"WITH {WORDS} SELECT doc_id, count(*) AS n_words, sum(b)::BIGINT AS begins, sum(e - b)::BIGINT AS letters FROM w GROUP BY doc_id")
def _(spark, sf_dir):
    words = vocabulary.words_in(corpus.load_set(spark, sf_dir, "validation"), "doc_id")
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum("begin").alias("begins"), F.sum(F.col("end") - F.col("begin")).alias("letters"))


@query("q_cuts_by_sevens", rf"""WITH {WORDS}, o AS (SELECT doc_id, i, 7 * i AS ob, least(7 * i + 7, length(text)) AS oe, substr(text, 7 * i + 1, 7) AS token FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 6) // 7)) AS i FROM v WHERE text <> '')),
    j AS (SELECT w.doc_id, b, word, string_agg(token, '|' ORDER BY ob) AS cut FROM w JOIN o ON o.doc_id = w.doc_id AND o.i BETWEEN b // 7 AND (e - 1) // 7 GROUP BY w.doc_id, b, word)
    SELECT word, count(*) AS occurrences, count(DISTINCT cut) AS ways FROM j GROUP BY word""")
def _(spark, sf_dir):
    """Words cut by tokens of seven characters wherever they stand: the interval join of words and tokens."""
    held = corpus.load_set(spark, sf_dir, "validation").where("text <> ''")
    tokens = held.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(7))).alias("o_begin"))
    tokens = tokens.select("doc_id", F.substring(F.col("text"), F.col("o_begin") + 1, F.lit(7)).alias("token"), F.col("o_begin").cast("long").alias("o_begin"), F.least(F.col("o_begin") + 7, F.length("text")).cast("long").alias("o_end"))
    return vocabulary.ways_to_cut(vocabulary.words_in(held, "doc_id"), tokens, "doc_id")


CHUNKED = chunks_sql("c0", "v", "doc_id").replace("SELECT doc_id, chunk FROM (SELECT doc_id, unnest(", "SELECT doc_id, i, chunk, row_number() OVER () AS r FROM (SELECT doc_id, i, unnest(") + ", o AS (SELECT doc_id, chunk, sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY i, r)::BIGINT AS oe FROM c0)"


@query("q_bits_on_characters", f"""WITH {D}, v AS (SELECT doc_id, text FROM d WHERE "set" = 'validation'), tr AS (SELECT doc_id, text FROM d WHERE "set" = 'train'), {chunks_sql('ct', 'tr', 'doc_id')}, {CHUNKED}, n AS (SELECT chunk, count(*) AS n FROM ct GROUP BY chunk), z AS (SELECT sum(n) AS total, count(*) AS kinds FROM n),
    b AS (SELECT doc_id, chunk, oe, -log2((coalesce(n, 0) + 1.0::DOUBLE) / (total + kinds + 1)) AS bits FROM o LEFT JOIN n USING (chunk), z), s AS (SELECT doc_id, oe - length(chunk) + k AS pos, bits / length(chunk) AS bits FROM (SELECT *, unnest(range(0, length(chunk))) AS k FROM b) UNION ALL SELECT doc_id, 0, log2(kinds + 2) FROM (SELECT DISTINCT doc_id FROM b), z)
    SELECT doc_id, pos // 5000 AS block, round(sum(bits), 4) AS bits, count(DISTINCT pos) AS n_chars FROM s GROUP BY ALL""")
def _(spark, sf_dir):
    """Chunks as tokens: their bits shared over their characters, START's on the first one, summed by blocks of 5,000 characters."""
    d = corpus.documents(spark, sf_dir)
    counts = bpe.chunk_counts(d.where("set = 'train'"))
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    held = d.where("set = 'validation'").select("doc_id", F.posexplode(chunks("text")).alias("pos", "token"))
    tokens = vocabulary.placed(held, "doc_id", "token").join(counts.withColumnRenamed("chunk", "token"), "token", "left")
    tokens = tokens.select("doc_id", F.col("o_begin").cast("long"), F.col("o_end").cast("long"), (-F.log2((F.coalesce("n", F.lit(0)) + 1.0) / (total + kinds + 1))).alias("bits"))
    starts = tokens.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(math.log2(kinds + 2)))
    on = vocabulary.shared_bits(tokens.unionAll(starts), "doc_id")
    return on.groupBy("doc_id", F.floor(F.col("at") / 5000).alias("block")).agg(F.round(F.sum("bits"), 4).alias("bits"), F.count("*").alias("n_chars"))


@query("q_token_stream", f"""WITH {D}, al AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')), v AS (SELECT doc_id, text FROM d WHERE "set" = 'validation' AND text <> ''), {chars_sql('c', 'v', 'doc_id')},
    s AS (SELECT doc_id, pos + 1 AS pos, id FROM c JOIN al USING (ch) UNION ALL SELECT doc_id, 0, (SELECT count(*) FROM al) FROM v) SELECT doc_id, count(*) AS n_tokens, md5(string_agg(id::VARCHAR, ' ' ORDER BY pos)) AS ids_md5 FROM s GROUP BY doc_id""")
def _(spark, sf_dir):
    """A stream written to files and read back, START checked before each text."""
    chars = _alphabet(corpus.documents(spark, sf_dir))
    vocab = spark.createDataFrame([(c, i) for i, c in enumerate(chars)], "ch string, token_id int")
    coded = characters(corpus.load_set(spark, sf_dir, "validation").where("text <> ''"), "doc_id").join(F.broadcast(vocab), "ch")  # an alphabet
    path = files.scratch(spark, "stream")
    vocabulary.write_stream(coded, len(chars), path)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"].cast("string")), " ")
    return vocabulary.read_stream(spark, path, len(chars)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.md5(ids).alias("ids_md5"))


@query("q_tokenizer_report")
def _(spark, sf_dir):
    """For each size of vocabulary: merges, tokens and characters a token of training and validation texts, what 256 tokens hold, how its entries are used, parameters of a model with it.

    The merges are learned once; smaller vocabularies take the first of them. The tokenizer goes through its file.
    """
    train, held = corpus.load_set(spark, sf_dir, "train"), corpus.load_set(spark, sf_dir, "validation")
    chars, counted, other = _alphabet(corpus.documents(spark, sf_dir)), bpe.chunk_counts(train).persist(), bpe.chunk_counts(held).persist()
    merges = bpe.learn(counted, max(SIZES) - len(chars) - 1)
    path = files.scratch(spark, "tokenizer") + ".json"
    vocabulary.save(spark, path, chars, merges, {"set": "train"})
    chars, merges = vocabulary.load(spark, path)
    out = None
    for size in [s for s in SIZES if len(chars) < s <= len(chars) + len(merges) + 1]:
        own = vocabulary.prefix(chars, merges, size)
        coded = lambda df: bpe.encode_chunks(df, own).join(df, "chunk")  # noqa: E731, B023
        used = coded(counted).select("n", F.explode("pieces").alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
        sums = lambda df, name: coded(df).agg(F.sum(F.size("pieces") * F.col("n")).alias(f"{name}_tokens"), (F.sum(F.length("chunk") * F.col("n")) / F.sum(F.size("pieces") * F.col("n"))).alias(f"{name}_chars_a_token"))
        row = vocabulary.usage(used, vocabulary.vocabulary(chars, own)).crossJoin(sums(counted, "train")).crossJoin(sums(other, "held"))  # one row each
        row = row.select(F.lit(size).alias("size"), F.lit(len(own)).alias("merges"), "*", (256 * F.col("train_chars_a_token")).alias("context_chars"), rules.parameters(F.lit(384), F.lit(6), F.lit(size), F.lit(256)).alias("parameters"))
        out = row if out is None else out.unionAll(row)
    return out


@query("q_chunk_rule")
def _(spark, sf_dir):
    """Merges learned with the chunk rule, and without it over whole texts: characters a token of held-out texts, pieces that straddle words, ways to cut the 20 most frequent words."""
    train, held = corpus.load_set(spark, sf_dir, "train"), corpus.load_set(spark, sf_dir, "validation")
    top = vocabulary.words_in(held, "doc_id").where(F.regexp_like("word", F.lit(r"^\p{Ll}{3,}$"))).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20).select("word")
    words = vocabulary.words_in(held, "doc_id").join(F.broadcast(top), "word")  # 20 rows
    out = None
    for rule, units in (("chunks", bpe.chunk_counts(train)), ("none", train.select(F.col("text").alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n")))):
        merges = (bpe.learn if rule == "chunks" else bpe.learn_along)(units, 1000)
        if rule == "chunks":
            coded = bpe.encode(held, merges).select("doc_id", F.col("pos").alias("chunk_pos"), F.posexplode("pieces").alias("at", "token")).select("doc_id", F.struct("chunk_pos", "at").alias("pos"), "token")
        else:
            coded = held.select("doc_id", "text").join(bpe.encode_chunks(held.select(F.col("text").alias("chunk")).distinct(), merges), F.col("text") == F.col("chunk")).select("doc_id", F.posexplode("pieces").alias("pos", "token"))
        tokens = vocabulary.placed(coded, "doc_id", "token").persist()
        straddle = sum(1 for a, b in merges if any(x and y for x, y in zip((a + b).split()[:-1], (a + b).split()[1:])))
        ways = vocabulary.ways_to_cut(words, tokens, "doc_id").agg(F.avg("ways").alias("mean_ways"))
        row = tokens.agg(F.count("*").alias("n_tokens"), (F.sum(F.length("token")) / F.count("*")).alias("chars_a_token")).crossJoin(ways)  # one row each
        row = row.select(F.lit(rule).alias("rule"), F.lit(len(merges)).alias("merges"), "n_tokens", "chars_a_token", F.lit(straddle).alias("straddling"), "mean_ways")
        out = row if out is None else out.unionAll(row)
    return out
