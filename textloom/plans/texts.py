"""Queries over texts: segmentation, models, overlap, lines."""

from __future__ import annotations

import bz2
import lzma
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import characters, chunks, normalised, plain
from ..operators import bpe, containment, lines, ngrams, overlap, vocabulary
from ..sources import arrays, corpus
from ..sources.files import materialise, scratch
from .registry import D, T, chars_sql, chunks_sql, lines_sql, query, windows_sql

WIDTHS = [20, 25, 30, 40, 50, 60, 80, 100]
ORDER = 8
#: As many as a vocabulary of 4,096 takes.
MERGES = 3998


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.load_set(spark, sf_dir, "train")


# ---- sources


@query("q_lines", f"WITH {D}, {lines_sql('l', 'd', 'doc_id')} SELECT * FROM l")
def _(spark, sf_dir):
    return corpus.lines(corpus.documents(spark, sf_dir))


@query("q_split_scan", f"WITH {D} SELECT doc_id, \"set\", sha256(text) AS sha256 FROM d WHERE \"set\" = 'validation'")
def _(spark, sf_dir):
    return corpus.load_set(spark, sf_dir, "validation").select("doc_id", "set", "sha256")


@query("q_checksum", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc, strlen(any_value(text)) AS n_bytes FROM documents GROUP BY text")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))
    return d.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("n_bytes").alias("n_bytes"))


@query("q_split_sizes", f"WITH {D} SELECT \"set\", count(*) AS docs, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / (SELECT sum(length(text)) FROM d), 9) AS share FROM d GROUP BY \"set\"")
def _(spark, sf_dir):
    per = corpus.documents(spark, sf_dir).groupBy("set").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    return per.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy()), 9))  # three rows


@query("q_split_rules", f"""WITH {D} SELECT (SELECT count(*) FROM (SELECT doc_id FROM d WHERE "set" <> 'train' INTERSECT SELECT doc_id FROM d WHERE "set" = 'train')) = 0 AS disjoint,
    (SELECT count(*) FROM (SELECT lang FROM d EXCEPT SELECT lang FROM d WHERE "set" <> 'train')) = 0 AS all_langs_held""")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    held, train = d.where("set <> 'train'"), d.where("set = 'train'")
    both = held.select("doc_id").intersect(train.select("doc_id")).agg((F.count("*") == 0).alias("disjoint"))
    return both.crossJoin(d.select("lang").subtract(held.select("lang")).agg((F.count("*") == 0).alias("all_langs_held")))


@query("q_alphabet", f"WITH {chars_sql('c', 'documents', 'doc_id')} SELECT ch, unicode(ch)::BIGINT AS codepoint, count(*) AS n, count(*) < 50 AS rare FROM c GROUP BY ch")
def _(spark, sf_dir):
    ch = characters(corpus.documents(spark, sf_dir)).groupBy("ch").agg(F.count("*").alias("n"))
    return ch.select("ch", F.ascii("ch").cast("long").alias("codepoint"), "n", (F.col("n") < 50).alias("rare"))


@query("q_alphabet_gap", f"WITH {D}, a AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM d), b AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM d WHERE \"set\" = 'train') SELECT ch FROM a EXCEPT SELECT ch FROM b")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    letters = lambda x: x.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    return letters(d).subtract(letters(d.where("set = 'train'")))


@query("q_unknown_chars", f"WITH {D}, b AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM d WHERE \"set\" = 'train'), {chars_sql('c', 'conversations', 'conv_id')} SELECT ch, count(*) AS n FROM c WHERE ch NOT IN (SELECT ch FROM b) GROUP BY ch")
def _(spark, sf_dir):
    known = _train(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).distinct()
    said = corpus.dealt(corpus.table(spark, sf_dir, "conversations")).select("conv_id", "text")
    return characters(said).groupBy("ch").agg(F.count("*").alias("n")).join(known, "ch", "left_anti")


@query("q_corpus_stats", r"""SELECT lang, count(*) AS docs, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(len(regexp_extract_all(text, '[^\t\n\f\r ]+')))::BIGINT AS words,
    sum(length(text))::BIGINT AS chars, round(sum(length(text)) / (SELECT sum(length(text)) FROM documents), 9) AS share, (SELECT count(DISTINCT ch) FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents e WHERE e.lang IS NOT DISTINCT FROM documents.lang AND text <> '')) AS alphabet FROM documents GROUP BY lang""")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    different = d.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct().groupBy("lang").agg(F.count("*").alias("alphabet"))
    per = d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.regexp_count("text", F.lit(r"[^\t\n\f\r ]+"))).alias("words"), F.sum(F.length("text")).alias("chars"))
    return per.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy()), 9)).join(different, "lang", "left")  # a row per language


@query("q_corpus_audit", r"""SELECT sum(len(regexp_extract_all(text, '\['))) ::BIGINT AS opened, sum(len(regexp_extract_all(text, '\]')))::BIGINT AS closed, sum(len(regexp_extract_all(text, '[0-9]')))::BIGINT AS digits,
    count(*) FILTER (WHERE len(regexp_extract_all(text, '\[')) <> len(regexp_extract_all(text, '\]'))) AS unbalanced,
    max((SELECT coalesce(max(length(x) - 1), 0) FROM unnest(regexp_extract_all(text, '\n+')) AS u(x)))::BIGINT AS longest_blank_run FROM documents""")
def _(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p))
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"\n+"), 0), lambda x: F.length(x) - 1)), F.lit(0))
    return corpus.documents(spark, sf_dir).agg(
        F.sum(n(r"\[")).alias("opened"), F.sum(n(r"\]")).alias("closed"), F.sum(n("[0-9]")).alias("digits"),
        F.count_if(n(r"\[") != n(r"\]")).alias("unbalanced"), F.max(run).cast("long").alias("longest_blank_run"),
    )


# ---- lines

CLEAN = r"""x AS (SELECT doc_id, line_no, text, trim(translate(text, chr(9), ' ')) = '' AS blank, translate(text, chr(9), ' ') AS a FROM l),
    y AS (SELECT *, rtrim(a, ' ') AS b FROM x), z AS (SELECT *, CASE WHEN b LIKE ' %' AND b NOT LIKE '  %' THEN substr(b, 2) ELSE b END AS c FROM y),
    c AS (SELECT doc_id, line_no, blank, a <> text AS e1, b <> a AS e2, c <> b AS e3, regexp_replace(c, '([^ ]) {2,}', '\1 ', 'g') <> c AS e4, regexp_replace(c, '([^ ]) {2,}', '\1 ', 'g') AS final FROM z)"""


@query("q_clean", f"""WITH {lines_sql('l', 'documents', 'doc_id')}, {CLEAN} SELECT doc_id, line_no, CASE WHEN NOT blank THEN final END AS text, CASE WHEN blank THEN 'blank line' END AS dropped_by,
    CASE WHEN blank THEN '' ELSE concat_ws(',', CASE WHEN e1 THEN 'tab' END, CASE WHEN e2 THEN 'trailing space' END, CASE WHEN e3 THEN 'indent' END, CASE WHEN e4 THEN 'doubled space' END) END AS edits FROM c""")
def _(spark, sf_dir):
    return lines.cleaned(corpus.lines(corpus.documents(spark, sf_dir))).withColumn("edits", F.array_join("edits", ","))


@query("q_clean_counts", f"""WITH {lines_sql('l', 'documents', 'doc_id')}, {CLEAN}, r AS (SELECT unnest(CASE WHEN blank THEN ['blank line'] ELSE list_filter([CASE WHEN e1 THEN 'tab' END, CASE WHEN e2 THEN 'trailing space' END, CASE WHEN e3 THEN 'indent' END, CASE WHEN e4 THEN 'doubled space' END], lambda q: q IS NOT NULL) END) AS rule FROM c)
    SELECT rule, count(*) AS n_lines FROM r GROUP BY rule""")
def _(spark, sf_dir):
    return lines.rule_counts(lines.cleaned(corpus.lines(corpus.documents(spark, sf_dir))))


@query("q_headings", f"""WITH h AS (SELECT doc_id, repeat(chr(10), 3) || upper(source) || chr(10) || chr(10) || text AS text FROM documents), {lines_sql('l', 'h', 'doc_id')},
    w AS (SELECT *, lag(text, 1) OVER v AS a, lag(text, 2) OVER v AS b, lag(text, 3) OVER v AS c, lead(text) OVER v AS z FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY line_no))
    SELECT doc_id, line_no, text FROM w WHERE trim(text) <> '' AND text NOT LIKE ' %' AND trim(a) = '' AND trim(b) = '' AND trim(c) = '' AND trim(z) = ''""")
def _(spark, sf_dir):
    laid = corpus.documents(spark, sf_dir).select("doc_id", F.concat(F.lit("\n\n\n"), F.upper("source"), F.lit("\n\n"), F.col("text")).alias("text"))
    return lines.headings(laid, "doc_id")


@query("q_transcript", f"WITH {T} SELECT conv_id, text FROM t")
def _(spark, sf_dir):
    return corpus.transcripts(spark, sf_dir)


LABELLED = rf"""{lines_sql('l', 't', 'conv_id')}, v AS (SELECT *, lag(text) OVER q AS before, lead(text) OVER q AS after, lead(text, 2) OVER q AS behind, max(line_no) OVER (PARTITION BY conv_id) AS last_line FROM l WINDOW q AS (PARTITION BY conv_id ORDER BY line_no)),
    m AS (SELECT *, coalesce(regexp_full_match(text, '[^a-z]*[A-Z][^a-z]*\.') AND before = '' AND line_no > 2 AND after <> '' AND NOT (regexp_full_match(after, '[^a-z]*[A-Z][^a-z]*\.') AND behind IS NOT NULL), false) AS is_label FROM v)"""


@query("q_labels", f"WITH {T}, {LABELLED} SELECT conv_id, line_no, text FROM m WHERE is_label")
def _(spark, sf_dir):
    return lines.marked(corpus.transcripts(spark, sf_dir), "conv_id").where("is_label").select("conv_id", "line_no", "text")


@query("q_label_share", f"WITH {T}, {LABELLED} SELECT sum(length(text) + 1) FILTER (WHERE is_label)::BIGINT AS label_chars, (SELECT sum(length(text)) FROM t)::BIGINT AS chars, round(sum(length(text) + 1) FILTER (WHERE is_label) / (SELECT sum(length(text)) FROM t), 9) AS share FROM m")
def _(spark, sf_dir):
    t = corpus.transcripts(spark, sf_dir)
    label = lines.marked(t, "conv_id").agg(F.sum(F.when(F.col("is_label"), F.length("text") + 1)).alias("label_chars"))
    return label.crossJoin(t.agg(F.sum(F.length("text")).alias("chars"))).withColumn("share", F.round(F.try_divide("label_chars", "chars"), 9))


@query("q_apparatus_share", rf"""WITH {T}, {LABELLED}, s AS (SELECT *, length(text) + CASE WHEN line_no < last_line THEN 1 ELSE 0 END AS size,
        is_label OR regexp_matches(text, '^(ACT |SCENE |PROLOGUE|EPILOGUE|INDUCTION|Dramatis Person|THE PROLOGUE|THE EPILOGUE)') OR regexp_matches(text, '^(Enter |Exeunt|Exit |Re-enter |Alarum|Flourish|Sennet|Manet|They fight|Music|Drum|Trumpet|A march|March|Retreat|Shout|Hautboys|Cornets|Thunder|Storm|Sound|Horns|Knock)') AS ours FROM m)
    SELECT conv_id, sum(size)::BIGINT AS n_chars, (sum(CASE WHEN ours THEN size ELSE 0 END) + coalesce(list_sum(list_transform(regexp_extract_all(string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE NOT ours), '(?s)\[_.*?_\.?\]'), lambda x: length(x))), 0))::BIGINT AS n_apparatus FROM s GROUP BY conv_id""")
def _(spark, sf_dir):
    return lines.apparatus(corpus.transcripts(spark, sf_dir), "conv_id")


# ---- segmentation


@query("q_plain", r"SELECT doc_id, trim(regexp_replace(replace(replace(lower(text), '’', ''), '‘', ''), '[^\p{L}]+', ' ', 'g')) AS plain FROM documents")
def _(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("doc_id", plain("text").alias("plain"))


@query("q_chunks", f"WITH {chunks_sql('c', 'documents', 'doc_id')} SELECT doc_id, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars FROM c GROUP BY doc_id")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("doc_id", chunks("text").alias("c")).where(F.size("c") > 0)
    return d.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"))


@query("q_chunk_freq", f"WITH {chunks_sql('c', 'documents', 'doc_id')} SELECT chunk, count(*) AS n FROM c GROUP BY chunk")
def _(spark, sf_dir):
    return bpe.chunk_counts(corpus.documents(spark, sf_dir))


PAIRS = f"""{D}, tr AS (SELECT * FROM d WHERE "set" = 'train'), {chunks_sql('c', 'tr', 'doc_id')}, f AS (SELECT chunk, count(*) AS n FROM c GROUP BY chunk),
    p AS (SELECT substr(chunk, i, 1) AS "left", substr(chunk, i + 1, 1) AS "right", sum(n)::BIGINT AS n FROM (SELECT chunk, n, unnest(range(1, length(chunk))) AS i FROM f) GROUP BY 1, 2)"""


@query("q_pair_counts", f"WITH {PAIRS} SELECT * FROM p")
def _(spark, sf_dir):
    return bpe.pair_counts(bpe.chunk_counts(_train(spark, sf_dir)))


@query("q_bpe_first_merge", f'WITH {PAIRS} SELECT "left", "right", n FROM p ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 1')
def _(spark, sf_dir):
    best = bpe.pair_counts(bpe.chunk_counts(_train(spark, sf_dir))).agg(F.max(F.struct("n", "left", "right")).alias("b"))
    return best.select("b.left", "b.right", "b.n")


@query("q_bpe_merges")
def _(spark, sf_dir):
    merges = bpe.learn(bpe.chunk_counts(_train(spark, sf_dir)), MERGES)
    return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string, piece string")


@query("q_bpe_encode")
def _(spark, sf_dir):
    held = corpus.load_set(spark, sf_dir, "validation")
    coded = bpe.encode(held, bpe.learn(bpe.chunk_counts(_train(spark, sf_dir)), MERGES))
    return coded.groupBy("doc_id").agg(F.sum(F.size("pieces")).alias("n_tokens"), F.sum(F.length("chunk")).alias("n_chars"))


@query("q_vocab_usage")
def _(spark, sf_dir):
    train = _train(spark, sf_dir)
    counted = materialise(bpe.chunk_counts(train), "chunks")
    merges = bpe.learn(counted, MERGES)
    used = counted.join(bpe.encode_chunks(counted, merges), "chunk").select("n", F.explode("pieces").alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
    vocab = characters(train).select(F.col("ch").alias("token")).distinct().unionAll(spark.createDataFrame([(a + b,) for a, b in merges], "token string")).distinct()
    n = F.coalesce("n", F.lit(0))
    return vocab.join(used, "token", "left").agg(F.count("*").alias("tokens"), F.count_if(n >= 100).alias("often"), F.count_if((n < 10) & (n > 0)).alias("seldom"), F.count_if(n == 0).alias("never"))


@query("q_ways_to_cut")
def _(spark, sf_dir):
    """How often each of the 20 most frequent words of three small letters or more stands in held-out texts, and in how many ways tokens cut it."""
    held = corpus.load_set(spark, sf_dir, "validation")
    merges = bpe.learn(bpe.chunk_counts(_train(spark, sf_dir)), MERGES)
    coded = bpe.encode(held, merges).select("doc_id", F.col("pos").alias("chunk"), F.posexplode("pieces").alias("at", "token"))
    tokens = vocabulary.placed(coded.select("doc_id", F.struct("chunk", "at").alias("pos"), "token"), "doc_id", "token")
    words = vocabulary.words_in(held, "doc_id").where(F.regexp_like("word", F.lit(r"^\p{Ll}{3,}$")))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20).select("word")
    return vocabulary.ways_to_cut(words.join(F.broadcast(top), "word"), tokens, "doc_id")  # 20 rows


ALPHABET = "al AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''))"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ch, id: characters in code-point order. Small and sorted in one place."""
    ch = corpus.documents(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    return ch.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ch")) - 1)


@query("q_char_encode", f"""WITH {D}, {ALPHABET}, v AS (SELECT * FROM d WHERE "set" = 'validation'), {chars_sql('c', 'v', 'doc_id')} SELECT doc_id, count(*) AS n_tokens, md5(string_agg(id::VARCHAR, ' ' ORDER BY pos)) AS ids_md5 FROM c JOIN al USING (ch) GROUP BY doc_id""")
def _(spark, sf_dir):
    ids = F.broadcast(_vocabulary(spark, sf_dir).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("ch", "id"))).alias("ids")))  # an alphabet
    d = corpus.load_set(spark, sf_dir, "validation").where("text <> ''").crossJoin(ids)
    coded = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: vocabulary.ids_of(c, F.col("ids")).cast("string"))
    return d.select("doc_id", F.length("text").cast("long").alias("n_tokens"), F.md5(F.array_join(coded, " ")).alias("ids_md5"))


@query("q_decode", f"WITH {D} SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM d WHERE \"set\" = 'validation' AND text <> ''")
def _(spark, sf_dir):
    both = _vocabulary(spark, sf_dir).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("ch", "id"))).alias("ids"), F.map_from_entries(F.collect_list(F.struct("id", "ch"))).alias("chs"))
    d = corpus.load_set(spark, sf_dir, "validation").where("text <> ''").crossJoin(F.broadcast(both))  # an alphabet
    coded = d.select("doc_id", "chs", F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: vocabulary.ids_of(c, F.col("ids"))).alias("coded"))
    back = coded.select("doc_id", F.array_join(F.transform("coded", lambda i: vocabulary.token_of(i, F.col("chs"))), "").alias("text"))
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("q_stream", f"WITH {D} SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS work, coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin, (length(text) + 1)::BIGINT AS n_tokens FROM d WHERE \"set\" = 'validation'")
def _(spark, sf_dir):
    """Where each text's START stands in the stream. Ranges are summed apart; only their totals meet."""
    sizes = corpus.load_set(spark, sf_dir, "validation").select("doc_id", (F.length("text") + 1).cast("long").alias("n_tokens"))
    placed = sizes.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("doc_id")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    offsets = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    own = placed.withColumns({"n": F.row_number().over(w) - 1, "s": F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return own.join(F.broadcast(offsets), "part").select("doc_id", (F.col("n") + F.col("c0")).alias("work"), (F.col("s") + F.col("t0")).alias("begin"), "n_tokens")


@query("q_offsets", f"WITH {chunks_sql('c0', 'documents', 'doc_id').replace('SELECT doc_id, chunk FROM (SELECT doc_id, unnest(', 'SELECT doc_id, i, chunk, row_number() OVER () AS r FROM (SELECT doc_id, i, unnest(')}, o AS (SELECT doc_id, sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY i, r) - length(chunk) AS begin FROM c0) SELECT doc_id, count(*) AS n, max(begin)::BIGINT AS last_begin, sum(begin)::BIGINT AS total FROM o GROUP BY doc_id")
def _(spark, sf_dir):
    """Of each text how many chunks it has, where the last begins, and the sum of all beginnings: a fold along the row, without a shuffle."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("at"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), a["at"].alias("last"), (a["total"] + a["at"]).alias("total"), (a["at"] + F.length(x)).alias("at"))
    d = corpus.documents(spark, sf_dir).select("doc_id", chunks("text").alias("c")).where(F.size("c") > 0)
    return d.select("doc_id", F.aggregate("c", zero, step).alias("x")).select("doc_id", "x.n", F.col("x.last").alias("last_begin"), "x.total")


@query("q_next_token", f"WITH {chars_sql('c', 'documents', 'doc_id')}, n AS (SELECT ch, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM c) SELECT ch, next, count(*) AS n FROM n WHERE next IS NOT NULL GROUP BY ch, next")
def _(spark, sf_dir):
    pairs = ngrams.counted(corpus.documents(spark, sf_dir), 2, pad="")
    return pairs.select(F.expr("left(piece, 1)").alias("ch"), F.expr("right(piece, 1)").alias("next"), "n")


GROUPS = """CASE WHEN regexp_matches(w, '^\\p{L}') THEN CASE WHEN times IS NULL THEN 'never seen' WHEN times < 10 THEN '1-9' WHEN times < 100 THEN '10-99' WHEN times < 1000 THEN '100-999' ELSE '1000 or more' END
    WHEN contains(chunk, chr(10)) THEN 'line breaks' WHEN w = '' THEN 'lone spaces' ELSE 'punctuation' END"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.lower(F.trim(F.translate("chunk", "\n", " ")))
    seen = bpe.chunk_counts(_train(spark, sf_dir)).select(word.alias("w"), "n").where(F.regexp_like("w", F.lit(r"^\p{L}"))).groupBy("w").agg(F.sum("n").alias("times"))
    held = bpe.chunk_counts(corpus.load_set(spark, sf_dir, "validation")).withColumn("w", word).join(seen, "w", "left")
    times = F.col("times")
    group = (
        F.when(F.regexp_like("w", F.lit(r"^\p{L}")), F.when(times.isNull(), "never seen").when(times < 10, "1-9").when(times < 100, "10-99").when(times < 1000, "100-999").otherwise("1000 or more"))
        .when(F.contains("chunk", F.lit("\n")), "line breaks").when(F.col("w") == "", "lone spaces").otherwise("punctuation")
    )
    return held.withColumn("grp", group)


GROUPED = rf"""{D}, tr AS (SELECT * FROM d WHERE "set" = 'train'), va AS (SELECT * FROM d WHERE "set" = 'validation'), {chunks_sql('ct', 'tr', 'doc_id')}, {chunks_sql('cv', 'va', 'doc_id')},
    s AS (SELECT lower(trim(replace(chunk, chr(10), ' '))) AS w, count(*) AS times FROM ct GROUP BY 1 HAVING regexp_matches(w, '^\p{{L}}')),
    h AS (SELECT chunk, lower(trim(replace(chunk, chr(10), ' '))) AS w, count(*) AS n FROM cv GROUP BY 1, 2), g AS (SELECT h.*, {GROUPS} AS grp FROM h LEFT JOIN s USING (w))"""


@query("q_chunk_groups", f"WITH {GROUPED} SELECT grp, sum(n)::BIGINT AS n_chunks, sum(n * length(chunk))::BIGINT AS n_chars FROM g GROUP BY grp")
def _(spark, sf_dir):
    return _grouped(spark, sf_dir).groupBy("grp").agg(F.sum("n").alias("n_chunks"), F.sum(F.col("n") * F.length("chunk")).alias("n_chars"))


UNIGRAM = """k AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM d WHERE "set" = 'train' AND text <> '') GROUP BY ch),
    z AS (SELECT sum(n) AS total, count(*) AS kinds, (SELECT count(DISTINCT ch) FROM (SELECT unnest(string_split(text, '')) AS ch FROM d WHERE text <> '')) AS size FROM k)"""


def _unigram(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """ch, bits: of each training character; and one row, unknown: of one that training lacks."""
    d = corpus.documents(spark, sf_dir)
    counts = ngrams.gram_counts(d.where("set = 'train'"), 1)
    size = d.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").agg(F.count_distinct("ch").alias("size"))
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).crossJoin(F.broadcast(size))  # one row each
    known = counts.crossJoin(F.broadcast(sums)).select(F.col("piece").alias("ch"), (-F.log2((F.col("n") + F.col("kinds") / F.col("size")) / (F.col("total") + F.col("kinds")))).alias("bits"))
    return known, F.broadcast(sums.select((-F.log2(F.col("kinds") / F.col("size") / (F.col("total") + F.col("kinds")))).alias("unknown"), "size"))


@query("q_bits_per_chunk", f"""WITH {GROUPED}, {UNIGRAM}, e AS (SELECT grp, n, chunk, unnest(string_split(chunk, '')) AS ch FROM g), b AS (SELECT grp, n, -log2((coalesce(k.n, 0) + kinds * (1.0::DOUBLE / size)) / (total + kinds)) AS bits FROM (SELECT e.grp, e.n AS n, e.ch FROM e) q LEFT JOIN k USING (ch), z)
    SELECT b.grp, round(sum(n * bits) / (SELECT sum(g.n) FROM g WHERE g.grp = b.grp), 6) AS bits_per_chunk FROM (SELECT grp, q.n AS n, bits FROM (SELECT e.grp, e.n, -log2((coalesce(k.n, 0) + kinds * (1.0::DOUBLE / size)) / (total + kinds)) AS bits FROM e LEFT JOIN k ON e.ch = k.ch, z) q) b GROUP BY b.grp""")
def _(spark, sf_dir):
    bits, unknown = _unigram(spark, sf_dir)
    held = _grouped(spark, sf_dir).select("grp", "n", F.posexplode(F.filter(F.split("chunk", ""), lambda c: c != "")).alias("i", "ch")).join(F.broadcast(bits), "ch", "left").crossJoin(unknown)
    total = held.groupBy("grp").agg(F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("chunks"), F.sum(F.col("n") * F.coalesce("bits", "unknown")).alias("bits"))
    return total.select("grp", F.round(F.col("bits") / F.col("chunks"), 6).alias("bits_per_chunk"))


@query("q_top_words", r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_’]+')) AS w FROM documents) WHERE regexp_full_match(w, '\p{Ll}{3,}') GROUP BY w ORDER BY n DESC, w LIMIT 150")
def _(spark, sf_dir):
    words = corpus.documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_’]+"), 0)).alias("word"))
    return words.where(F.regexp_like("word", F.lit(r"^\p{Ll}{3,}$"))).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(150)


@query("q_novel_words", r"""WITH w AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM conversations) WHERE length(w) > 5), c AS (SELECT lower(text) AS text FROM documents)
    SELECT word FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE contains(c.text, w.word)) ORDER BY word LIMIT 40""")
def _(spark, sf_dir):
    """Invented words: in no document, not even inside another word. A word that is a document's own word needs no search."""
    words = lambda df: df.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    said = words(corpus.dealt(corpus.table(spark, sf_dir, "conversations")).select("text")).where(F.length("word") > 5)
    known = words(corpus.documents(spark, sf_dir))
    left = materialise(said.join(known, "word", "left_anti"), "words")
    left = left.join(containment.contained(left, known), "word", "left_anti")
    return left.orderBy("word").limit(40)


@query("q_phrase_lookup", "WITH p(phrase) AS (VALUES ('mit license'), ('the the'), ('no such phrase'), ('and the')) SELECT phrase, EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), phrase)) AS in_documents, EXISTS (SELECT 1 FROM conversations WHERE contains(lower(text), phrase)) AS in_conversations FROM p")
def _(spark, sf_dir):
    phrases = ["mit license", "the the", "no such phrase", "and the"]
    held = lambda df: df.agg(*[F.coalesce(F.bool_or(F.contains(F.lower("text"), F.lit(p))), F.lit(False)).alias(p) for p in phrases])
    tall = lambda df, name: df.select(F.explode(F.create_map(*[x for p in phrases for x in (F.lit(p), F.col(p))])).alias("phrase", name))
    return tall(held(corpus.documents(spark, sf_dir)), "in_documents").join(tall(held(corpus.dealt(corpus.table(spark, sf_dir, "conversations"))), "in_conversations"), "phrase")


@query("q_normalise")
def _(spark, sf_dir):
    alphabet = frozenset(map(chr, range(32, 127))) | frozenset("\n’“”—éàèçäöüßñóí") - {'"', "'"}

    @F.pandas_udf("struct<fed: string, notes: array<string>, refused: string>")
    def one(prompt: pd.Series) -> pd.DataFrame:
        rows = []
        for p in prompt:
            try:
                rows.append((*normalised(p, alphabet), None))
            except ValueError as e:
                rows.append((None, [], str(e)))
        return pd.DataFrame(rows, columns=["fed", "notes", "refused"])

    turns = corpus.dealt(corpus.table(spark, sf_dir, "conversations")).select("conv_id", "turn", one("text").alias("x"))
    return turns.select("conv_id", "turn", "x.fed", F.array_join("x.notes", "; ").alias("notes"), "x.refused")


def _xz(raw: bytes) -> int:
    """Bytes under xz -9e. The dictionary is no larger than the text needs: clearing tables for one of 64 MB takes longer than a text."""
    need = min(64 << 20, max(1 << 20, 1 << (len(raw) - 1).bit_length() if raw else 0))
    return len(lzma.compress(raw, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME, "dict_size": need}]))


@query("q_compress")
def _(spark, sf_dir):
    """Bits per character of each language's validation texts under bzip2 and xz, text by text."""

    @F.pandas_udf("struct<bz: long, xz: long>")
    def sizes(text: pd.Series) -> pd.DataFrame:
        raw = [t.encode() for t in text]
        return pd.DataFrame({"bz": [8 * len(bz2.compress(r, 9)) for r in raw], "xz": [8 * _xz(r) for r in raw]})

    held = corpus.load_set(spark, sf_dir, "validation").select("lang", F.length("text").alias("n"), sizes("text").alias("s"))
    return held.groupBy("lang").agg((F.sum("s.bz") / F.sum("n")).alias("bzip2"), (F.sum("s.xz") / F.sum("n")).alias("xz"))


@query("q_compress_after")
def _(spark, sf_dir):
    """Bits per character of each validation text when the compressor has read another text of its language: the extra bytes alone."""

    @F.pandas_udf("struct<bz: long, xz: long>")
    def extra(text: pd.Series, prior: pd.Series) -> pd.DataFrame:
        squeeze = {"bz": lambda x: len(bz2.compress(x, 9)), "xz": _xz}
        texts = [(p or "", (p or "") + t) for t, p in zip(text, prior)]
        alone = {p: {k: f(p.encode()) if p else 0 for k, f in squeeze.items()} for p in {p for p, _ in texts}}  # once a batch, not once a text
        return pd.DataFrame({k: [8 * (f(both.encode()) - alone[p][k]) for p, both in texts] for k, f in squeeze.items()})

    read = _train(spark, sf_dir).groupBy("lang").agg(F.max_by("text", F.struct(F.length("text"), "doc_id")).alias("prior"))  # the longest
    held = corpus.load_set(spark, sf_dir, "validation").where("text <> ''").join(F.broadcast(read), "lang", "left")  # a row per language
    bits = held.select("doc_id", "lang", F.length("text").alias("n"), extra("text", "prior").alias("s"))
    return bits.select("doc_id", "lang", (F.col("s.bz") / F.col("n")).alias("bzip2"), (F.col("s.xz") / F.col("n")).alias("xz"))


# ---- models


def _model_sql(order: int) -> str:
    """p1 .. p{order} for each distinct scored n-gram q(piece)."""
    text = f"""pt AS (SELECT repeat(chr(1), {order - 1}) || text AS text, lang, doc_id, "set" FROM d WHERE text <> ''), tr AS (SELECT * FROM pt WHERE "set" = 'train'), va AS (SELECT * FROM pt WHERE "set" = 'validation'),
        {windows_sql('wt', 'tr', 'doc_id', order)}, {windows_sql('wv', 'va', 'doc_id, lang', order)},
        base AS (SELECT piece, count(*) AS n FROM wt GROUP BY piece), size AS (SELECT count(DISTINCT ch) AS a FROM (SELECT unnest(string_split(text, '')) AS ch FROM d WHERE text <> '')),
        p0 AS (SELECT piece, 1.0::DOUBLE / a AS p0 FROM (SELECT DISTINCT piece FROM wv), size)"""
    for k in range(1, order + 1):
        text += f""", g{k} AS (SELECT right(piece, {k}) AS gram, sum(n) AS n FROM base GROUP BY 1), c{k} AS (SELECT left(gram, {k - 1}) AS ctx, sum(n) AS total, count(*) AS kinds FROM g{k} GROUP BY 1),
        p{k} AS (SELECT x.*, CASE WHEN total IS NULL THEN p{k - 1} ELSE (coalesce(n, 0) + kinds * p{k - 1}) / (total + kinds) END AS p{k} FROM p{k - 1} x LEFT JOIN g{k} ON right(x.piece, {k}) = gram LEFT JOIN c{k} ON left(right(x.piece, {k}), {k - 1}) = ctx)"""
    return text


BITS = ", ".join(f"round(-sum(log2(p{k})) / count(*), 6) AS bits{k}" for k in range(1, ORDER + 1))


@query("q_ngram_counts", f"WITH {D}, pt AS (SELECT chr(1) || chr(1) || text AS text, doc_id FROM d WHERE \"set\" = 'train' AND text <> ''), {windows_sql('w', 'pt', 'doc_id', 3)} SELECT left(piece, 2) AS ctx, right(piece, 1) AS ch, count(*) AS n FROM w GROUP BY piece")
def _(spark, sf_dir):
    return ngrams.gram_counts(_train(spark, sf_dir), 3).select(F.expr("left(piece, 2)").alias("ctx"), F.expr("right(piece, 1)").alias("ch"), "n")


@query("q_ngram_bits", f"WITH {D}, {_model_sql(ORDER)} SELECT lang, count(*) AS n_chars, round(-sum(log2(p{ORDER})) / count(*), 6) AS bits FROM wv JOIN p{ORDER} USING (piece) GROUP BY lang")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    got = ngrams.score_orders(d.where("set = 'validation'"), d.where("set = 'train'"), ORDER, ngrams.alphabet_size(d), "lang")
    return got.select("lang", "n_chars", F.round(F.col(f"bits{ORDER}") / F.col("n_chars"), 6).alias("bits"))


@query("q_baseline_table", f"WITH {D}, {_model_sql(ORDER)} SELECT count(*) AS n_chars, {BITS} FROM wv JOIN p{ORDER} USING (piece)")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    got = ngrams.score_orders(d.where("set = 'validation'"), d.where("set = 'train'"), ORDER, ngrams.alphabet_size(d))
    return got.select("n_chars", *[F.round(F.col(f"bits{k}") / F.col("n_chars"), 6).alias(f"bits{k}") for k in range(1, ORDER + 1)])


@query("q_leave_one_work_out", f"""WITH {D}, {_model_sql(2)}, w AS (SELECT doc_id, -sum(log2(p2)) AS bits, count(*) AS n FROM wv JOIN p2 USING (piece) GROUP BY doc_id) SELECT doc_id, round(((SELECT sum(bits) FROM w) - bits) / ((SELECT sum(n) FROM w) - n), 6) AS without FROM w""")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    per = ngrams.score_orders(d.where("set = 'validation'"), d.where("set = 'train'"), 2, ngrams.alphabet_size(d), "doc_id")
    per = materialise(per, "works")
    whole = per.agg(F.sum("bits2").alias("bits"), F.sum("n_chars").alias("n"))  # one row
    return per.crossJoin(F.broadcast(whole)).select("doc_id", F.round((F.col("bits") - F.col("bits2")) / (F.col("n") - F.col("n_chars")), 6).alias("without"))


@query("q_breakdown", f"""WITH {D}, {T}, {LABELLED}, {UNIGRAM}, s AS (SELECT conv_id, is_label, text || CASE WHEN line_no < last_line THEN chr(10) ELSE '' END AS text FROM m),
    e AS (SELECT conv_id, is_label, unnest(string_split(text, '')) AS ch FROM s WHERE text <> ''), b AS (SELECT conv_id, is_label, -log2((coalesce(n, 0) + kinds * (1.0::DOUBLE / size)) / (total + kinds)) AS bits FROM e LEFT JOIN k USING (ch), z)
    SELECT conv_id, is_label, count(*) AS n_chars, round(sum(bits) / count(*), 6) AS bits FROM b GROUP BY GROUPING SETS ((), (conv_id), (is_label))""")
def _(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    marked = lines.marked(corpus.transcripts(spark, sf_dir), "conv_id")
    text = marked.withColumn("text", F.concat("text", F.when(F.col("is_last"), "").otherwise("\n")))
    scored = ngrams.score_orders(text, d.where("set = 'train'"), 1, ngrams.alphabet_size(d), "conv_id", "is_label")
    sets = scored.groupingSets([[], ["conv_id"], ["is_label"]], "conv_id", "is_label")
    return sets.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.round(F.sum("bits1") / F.sum("n_chars"), 6).alias("bits"))


@query("q_bits_by_char", f"""WITH {D}, {UNIGRAM}, v AS (SELECT doc_id, text FROM d WHERE "set" = 'validation'), {chars_sql('c', 'v', 'doc_id')}, b AS (SELECT doc_id, pos, -log2((coalesce(n, 0) + kinds * (1.0::DOUBLE / size)) / (total + kinds)) + CASE WHEN pos = 0 THEN log2(size + 1) ELSE 0 END AS bits FROM c LEFT JOIN k USING (ch), z)
    SELECT doc_id, round(max(CASE WHEN pos = 0 THEN bits END), 6) AS first_bits, round(sum(bits), 4) AS bits FROM b GROUP BY doc_id""")
def _(spark, sf_dir):
    """START costs the same before each text, stands for no character, and is billed to the one behind it."""
    d = corpus.documents(spark, sf_dir)
    size = ngrams.alphabet_size(d)
    held = d.where("set = 'validation' AND text <> ''").select("doc_id", "text", F.explode(F.array(F.lit(""), F.left("text", F.lit(1)))).alias("first"))
    held = held.withColumn("text", F.when(F.col("first") == "", F.col("text")).otherwise(F.col("first")))  # each text, and its first character by itself
    scored = ngrams.score_orders(held, d.where("set = 'train'"), 1, size, "doc_id", "first")
    whole, start = F.col("first") == "", F.lit(math.log2(size + 1))
    first = F.max(F.when(~whole, F.col("bits1") / F.col("n_chars"))) + start
    return scored.groupBy("doc_id").agg(F.round(first, 6).alias("first_bits"), F.round(F.sum(F.when(whole, F.col("bits1")).otherwise(F.col("n_chars") * start)), 4).alias("bits"))


@query("q_surprise_arrays", rf"""WITH {D}, {UNIGRAM}, v AS (SELECT doc_id, text FROM d WHERE "set" = 'validation'), {chars_sql('c', 'v', 'doc_id')}, b AS (SELECT doc_id, pos, ch, -log2((coalesce(n, 0) + kinds * (1.0::DOUBLE / size)) / (total + kinds)) AS bits FROM c LEFT JOIN k USING (ch), z)
    SELECT doc_id, count(*) AS n_chars, round(sum(bits), 4) AS bits, round(coalesce(sum(bits) FILTER (WHERE regexp_matches(ch, '\p{{L}}')), 0), 4) AS letter_bits FROM b WHERE pos < 2000 GROUP BY doc_id""")
def _(spark, sf_dir):
    """Surprise and a mask of letters, written as arrays by position and read back: the first 2,000 characters of each held-out text, by what they cost."""
    arrays.register(spark)
    d = corpus.documents(spark, sf_dir)
    own = ngrams.each_character(d.where("set = 'validation'").select(F.col("doc_id").cast("string").alias("name"), "text"), d.where("set = 'train'"), ngrams.alphabet_size(d), "name")
    paths = {c: scratch(spark, c) for c in ("bits", "is_letter")}
    for c, path in paths.items():
        own.select("name", "pos", F.col(c).alias("value")).write.format("arrays").mode("append").save(path)
    read = lambda c: spark.read.format("arrays").load(paths[c]).where("pos < 2000").withColumnRenamed("value", c)
    both = read("bits").join(read("is_letter"), ["name", "pos"])
    return both.groupBy(F.col("name").cast("long").alias("doc_id")).agg(F.count("*").alias("n_chars"), F.round(F.sum("bits"), 4).alias("bits"), F.round(F.coalesce(F.sum(F.when(F.col("is_letter"), F.col("bits"))), F.lit(0.0)), 4).alias("letter_bits"))


FOLLOW = f"""{D}, pt AS (SELECT repeat(chr(1), 2) || text AS text, lang, doc_id, "set" FROM d WHERE text <> ''), tr AS (SELECT * FROM pt WHERE "set" = 'train'), va AS (SELECT * FROM pt WHERE "set" = 'validation'), {windows_sql('wt', 'tr', 'doc_id', 3)}, {windows_sql('wv', 'va', 'doc_id', 3)},
    f AS (SELECT left(piece, 2) AS ctx, right(piece, 1) AS ch, count(*) AS n FROM wt GROUP BY piece)"""


def _followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.gram_counts(_train(spark, sf_dir), 3).select(F.expr("left(piece, 2)").alias("ctx"), F.expr("right(piece, 1)").alias("ch"), "n")


@query("q_greedy_next", f"WITH {FOLLOW} SELECT ctx, arg_max(ch, (n, -unicode(ch))) AS next FROM f GROUP BY ctx")
def _(spark, sf_dir):
    return _followers(spark, sf_dir).groupBy("ctx").agg(F.max_by("ch", F.struct("n", -F.ascii("ch"))).alias("next"))


@query("q_top_k", f"WITH {FOLLOW} SELECT ctx, ch, n FROM (SELECT *, rank() OVER (PARTITION BY ctx ORDER BY n DESC) AS r FROM f) WHERE r <= 3")
def _(spark, sf_dir):
    """Ties at the third stay."""
    return _followers(spark, sf_dir).withColumn("r", F.rank().over(Window.partitionBy("ctx").orderBy(F.desc("n")))).where("r <= 3").drop("r")


@query("q_top_p", f"WITH {FOLLOW}, c AS (SELECT ctx, ch, n, sum(n) OVER (PARTITION BY ctx) AS total, sum(n) OVER (PARTITION BY ctx ORDER BY n DESC, ch) AS upto FROM f) SELECT ctx, ch, n FROM c WHERE (upto - n) * 10 < total * 9")
def _(spark, sf_dir):
    w = Window.partitionBy("ctx")
    c = _followers(spark, sf_dir).withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy(F.desc("n"), "ch"))})
    return c.where((F.col("upto") - F.col("n")) * 10 < F.col("total") * 9).select("ctx", "ch", "n")


def _agreed(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    best = _followers(spark, sf_dir).groupBy("ctx").agg(F.max_by("ch", F.struct("n", -F.ascii("ch"))).alias("next"))
    return ngrams.agreement(corpus.load_set(spark, sf_dir, "validation"), best, "doc_id", least)


AGREED = f"{FOLLOW}, best AS (SELECT ctx, arg_max(ch, (n, -unicode(ch))) AS next FROM f GROUP BY ctx), ag AS (SELECT doc_id, pos, coalesce(right(piece, 1) = next, false) AS agreed FROM wv LEFT JOIN best ON left(piece, 2) = ctx)"


@query("q_agreement", f"WITH {AGREED} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE agreed) AS agreed FROM ag GROUP BY doc_id")
def _(spark, sf_dir):
    return _agreed(spark, sf_dir).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("agreed").alias("agreed"))


@query("q_agreement_runs", f"WITH {AGREED}, i AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM ag WHERE agreed) SELECT doc_id, min(pos) AS begin, count(*) AS length FROM i GROUP BY doc_id, island HAVING count(*) >= 8")
def _(spark, sf_dir):
    return _agreed(spark, sf_dir, 8)


# ---- overlap


def _held_and_rest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return corpus.load_set(spark, sf_dir, "validation").select("doc_id", "text"), _train(spark, sf_dir).select("doc_id", "text")


HELD = f"{D}, va AS (SELECT doc_id, text FROM d WHERE \"set\" = 'validation'), tr AS (SELECT doc_id, text FROM d WHERE \"set\" = 'train')"


@query("q_copy_windows", f"WITH {HELD}, {windows_sql('a', 'va', 'doc_id', 50)}, {windows_sql('b', 'tr', 'doc_id', 50)} SELECT doc_id, pos FROM a WHERE piece IN (SELECT piece FROM b)")
def _(spark, sf_dir):
    return overlap.copied(*_held_and_rest(spark, sf_dir), 50, "doc_id")


def _curve_sql(w: int) -> str:
    return f"""SELECT {w} AS width, (SELECT sum(greatest(length(text) - {w - 1}, 0)) FROM va)::BIGINT AS windows, count(*) AS matched, round(count(*) / (SELECT sum(greatest(length(text) - {w - 1}, 0)) FROM va), 9) AS share,
        round(coalesce(sum(least({w}, coalesce(nxt - pos, {w}))), 0) / (SELECT sum(length(text)) FROM va), 9) AS share_of_chars FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM a{w} WHERE piece IN (SELECT piece FROM b{w}))"""


@query("q_copy_curve", f"WITH {HELD}, " + ", ".join(f"{windows_sql(f'a{w}', 'va', 'doc_id', w)}, {windows_sql(f'b{w}', 'tr', 'doc_id', w)}" for w in WIDTHS) + " " + " UNION ALL ".join(map(_curve_sql, WIDTHS)))
def _(spark, sf_dir):
    got = overlap.curve(*_held_and_rest(spark, sf_dir), WIDTHS, "doc_id")
    return got.withColumns({c: F.round(c, 9) for c in ("share", "share_of_chars")})


@query("q_copy_curve_author", rf"WITH {HELD}, {windows_sql('a', 'va', 'doc_id', 50)}, {windows_sql('b', 'tr', 'doc_id', 50)}, f AS (SELECT * FROM a WHERE len(regexp_extract_all(piece, '[\p{{L}}\p{{Nl}}\p{{No}}]')) >= 25) SELECT count(*) AS windows, count(*) FILTER (WHERE piece IN (SELECT piece FROM b)) AS matched FROM f")
def _(spark, sf_dir):
    """Only windows of 25 letters or more."""
    return overlap.lettered(*_held_and_rest(spark, sf_dir), 50, 25)


@query("q_loo_overlap", "WITH " + ", ".join(windows_sql(f"a{w}", "documents", "doc_id", w) for w in WIDTHS) + " " + " UNION ALL ".join(f"SELECT {w} AS width, sum(n)::BIGINT AS windows, coalesce(sum(n) FILTER (WHERE x <> y), 0)::BIGINT AS shared FROM (SELECT count(*) AS n, min(doc_id) AS x, max(doc_id) AS y FROM a{w} GROUP BY piece)" for w in WIDTHS))
def _(spark, sf_dir):
    return overlap.held_elsewhere(corpus.documents(spark, sf_dir), WIDTHS, "doc_id")


@query("q_loo_without", "WITH " + ", ".join(windows_sql(f"a{w}", "documents", "doc_id", w) for w in (30, 60)) + " " + " UNION ALL ".join(f"SELECT {w} AS width, sum(n)::BIGINT AS windows, coalesce(sum(n) FILTER (WHERE x <> y), 0)::BIGINT AS shared FROM (SELECT count(*) FILTER (WHERE doc_id % 7 <> 3) AS n, min(doc_id) AS x, max(doc_id) AS y FROM a{w} GROUP BY piece)" for w in (30, 60)))
def _(spark, sf_dir):
    """Without the windows of a list of documents, which still hold those of others."""
    return overlap.held_elsewhere(corpus.documents(spark, sf_dir), [30, 60], "doc_id", F.col("doc_id") % 7 != 3)


@query("q_leak", f"""WITH {windows_sql('a', 'benchmark', 'item_id', 50)}, {windows_sql('b', 'documents', 'doc_id', 50)}, fa AS (SELECT item_id, piece, min(pos) AS pa FROM a GROUP BY ALL), fb AS (SELECT doc_id, piece, min(pos) AS pb FROM b WHERE piece IN (SELECT piece FROM a) GROUP BY ALL),
    j AS (SELECT item_id, doc_id, pa, pb, pa - row_number() OVER (PARTITION BY item_id, doc_id, pa - pb ORDER BY pa) AS island FROM fa JOIN fb USING (piece))
    SELECT item_id, doc_id, min(pa) AS begin_item, min(pb) AS begin_doc, count(*) + 49 AS length FROM j GROUP BY item_id, doc_id, pa - pb, island""")
def _(spark, sf_dir):
    items = corpus.dealt(corpus.table(spark, sf_dir, "benchmark"))
    got = overlap.passages(items, corpus.documents(spark, sf_dir), 50, "item_id", "doc_id")
    return got.select("item_id", "doc_id", F.col("begin_a").cast("long").alias("begin_item"), F.col("begin_b").cast("long").alias("begin_doc"), "length")


@query("q_longest_copy")
def _(spark, sf_dir):
    held, rest = _held_and_rest(spark, sf_dir)
    return spark.createDataFrame([overlap.longest(held, rest)], "longest int, doc_id long, pos long")
