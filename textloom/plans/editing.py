"""Queries that clean texts by rules, and tell an editor's words from an author's."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bpe, editing, lines, overlap
from ..sources import corpus
from .registry import T, chunks_sql, lines_sql, query, windows_sql
from .texts import LABELLED

#: Documents as raw files: markers, a list of contents, a cast heading with a stray space, a margin number, blank lines at the end.
RAW = "raw AS (SELECT doc_id, '*** START OF ' || doc_id || ' ***' || chr(10) || 'Contents' || chr(10) || '    ' || coalesce(lang, '') || chr(10) || '    ' || coalesce(source, '') || chr(10) || ' Dramatis' || chr(10) || text || '   ' || doc_id || chr(10) || chr(10) || ' ' || chr(10) || '*** END OF ' || doc_id || ' ***' AS text FROM documents)"
EDITED = rf"""{RAW}, {lines_sql('l', 'raw', 'doc_id')},
    a AS (SELECT *, trim(replace(text, chr(9), ' ')) = '' AS blank, starts_with(text, '*** ') AS marker, max(CASE WHEN text = 'Contents' THEN line_no END) OVER w AS b, max(CASE WHEN text = ' Dramatis' THEN line_no END) OVER w AS e FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    d AS (SELECT *, CASE WHEN marker THEN 'markers' WHEN b > coalesce(e, 0) THEN 'contents' WHEN blank AND line_no > max(CASE WHEN NOT blank AND NOT marker THEN line_no END) OVER (PARTITION BY doc_id) THEN 'blank lines at the end' END AS dropped_by, CASE WHEN line_no = 5 THEN 'Dramatis' ELSE text END AS t0 FROM a),
    e1 AS (SELECT *, regexp_replace(t0, '(\S) +\d+$', '\1') AS t1 FROM d), e2 AS (SELECT *, regexp_replace(t1, ' ?\t ?', ' ', 'g') AS t2 FROM e1), e3 AS (SELECT *, rtrim(t2, ' ') AS t3 FROM e2),
    e4 AS (SELECT *, CASE WHEN t3 LIKE ' %' AND t3 NOT LIKE '  %' AND NOT (doc_id % 7 = 0 AND line_no % 2 = 0) THEN substr(t3, 2) ELSE t3 END AS t4 FROM e3), e5 AS (SELECT *, regexp_replace(t4, '([^ _\t\n\f\r]) {{2,}}', '\1 ', 'g') AS t5 FROM e4),
    x AS (SELECT doc_id, line_no, dropped_by, CASE WHEN dropped_by IS NULL THEN t5 ELSE text END AS text, CASE WHEN dropped_by IS NOT NULL THEN [] ELSE list_filter([CASE WHEN t0 <> text THEN 'cast heading' END, CASE WHEN t1 <> t0 THEN 'margin number' END, CASE WHEN t2 <> t1 THEN 'tab' END,
        CASE WHEN t3 <> t2 THEN 'trailing space' END, CASE WHEN t4 <> t3 THEN 'one-space indent' END, CASE WHEN t5 <> t4 THEN 'doubled space' END], lambda q: q IS NOT NULL) END AS edits FROM e5)"""


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir).where("text IS NOT NULL")
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = docs.select("doc_id", F.concat(
        F.lit("*** START OF "), F.col("doc_id").cast("string"), F.lit(" ***\nContents\n    "), none("lang"), F.lit("\n    "), none("source"), F.lit("\n Dramatis\n"), F.col("text"), F.lit("   "), F.col("doc_id").cast("string"),
        F.lit("\n\n \n*** END OF "), F.col("doc_id").cast("string"), F.lit(" ***")).alias("text"))
    found = editing.opened(corpus.lines(raw))
    marker, text = F.col("text").startswith("*** "), F.col("text")
    found = editing.drop(found, "doc_id", {
        "markers": marker, "contents": editing.between("doc_id", text == "Contents", text == " Dramatis"),
        "blank lines at the end": editing.blank("text") & editing.behind_last("doc_id", ~editing.blank("text") & ~marker),
    })
    heading = docs.select("doc_id", F.lit(5).cast("long").alias("line_no"), F.lit(" Dramatis").alias("before"), F.lit("Dramatis").alias("after"), F.lit("cast heading").alias("rule"))
    found = editing.edit_lines(found, "doc_id", heading)
    stepped = (F.col("doc_id") % 7 == 0) & (F.col("line_no") % 2 == 0)  # lines that keep their indent
    for rule, change in editing.PATTERNS.items():
        found = editing.edit_pattern(found, rule, change, stepped if rule == "one-space indent" else None)
    return found


@query("q_edit_rules", f"WITH {EDITED} SELECT doc_id, line_no, dropped_by, text, array_to_string(edits, ',') AS edits FROM x")
def _(spark, sf_dir):
    return _edited(spark, sf_dir).select("doc_id", "line_no", "dropped_by", "text", F.array_join("edits", ",").alias("edits"))


@query("q_edit_account", f"""WITH {EDITED}, n AS (SELECT doc_id, line_no, i, rule FROM (SELECT doc_id, line_no, unnest(CASE WHEN dropped_by IS NULL THEN edits ELSE [dropped_by] END) AS rule, generate_subscripts(CASE WHEN dropped_by IS NULL THEN edits ELSE [dropped_by] END, 1) AS i FROM x)),
    f AS (SELECT rule, count(*) AS n_lines, min({{'d': doc_id, 'l': line_no, 'i': i}}) AS first FROM n GROUP BY rule) SELECT rule, n_lines, row_number() OVER (ORDER BY first) AS touch FROM f""")
def _(spark, sf_dir):
    return editing.account(_edited(spark, sf_dir), "doc_id").withColumn("touch", F.col("touch").cast("long"))


@query("q_edit_audit", rf"""WITH {EDITED} SELECT count(*) AS n_lines, count(dropped_by) AS n_dropped, count(*) FILTER (WHERE dropped_by IS NULL) AS n_kept, count(*) FILTER (WHERE dropped_by IS NULL AND text = 'Dramatis') AS n_headings,
    count(DISTINCT doc_id) AS n_texts, count(*) FILTER (WHERE dropped_by IS NULL AND contains(text, chr(9))) AS n_tabs, sum(length(text)) FILTER (WHERE dropped_by IS NULL)::BIGINT AS n_chars FROM x""")
def _(spark, sf_dir):
    """Every line is kept or dropped, every text has its heading, no tab is left: else nothing is given."""
    kept = F.col("dropped_by").isNull()
    audit = _edited(spark, sf_dir).agg(
        F.count("*").alias("n_lines"), F.count("dropped_by").alias("n_dropped"), F.count_if(kept).alias("n_kept"), F.count_if(kept & (F.col("text") == "Dramatis")).alias("n_headings"),
        F.count_distinct("doc_id").alias("n_texts"), F.count_if(kept & F.contains("text", F.lit("\t"))).alias("n_tabs"), F.sum(F.when(kept, F.length("text"))).alias("n_chars"),
    )
    return editing.gate(audit, all_lines_are_accounted_for=F.bool_and(F.col("n_lines") == F.col("n_dropped") + F.col("n_kept")), a_heading_for_each_text=F.bool_and(F.col("n_headings") >= F.col("n_texts")), no_tabs=F.bool_and(F.col("n_tabs") == 0))


@query("q_slugs", r"SELECT doc_id, lpad((doc_id % 100)::VARCHAR, 2, '0') || '-' || trim(regexp_replace(lower(regexp_replace(strip_accents(replace(substr(text, 1, 40), '’', '')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents WHERE text <> ''")
def _(spark, sf_dir):
    """A file name of a number and a title: accents off, other characters one hyphen."""

    @F.pandas_udf("string")
    def bare(title: pd.Series) -> pd.Series:
        plain = title.map(lambda t: unicodedata.normalize("NFKD", t.replace("’", "")).encode("ascii", "ignore").decode().lower())
        return plain.map(lambda t: re.sub("[^a-z0-9]+", "-", t).strip("-"))

    docs = corpus.documents(spark, sf_dir).where("text <> ''")
    return docs.select("doc_id", F.concat(F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("-"), bare(F.substring("text", 1, 40))).alias("slug"))


# ---- the editor and the author

SPANS = f"""{LABELLED}, z AS (SELECT *, length(text) + CASE WHEN line_no < last_line THEN 1 ELSE 0 END AS size, is_label OR regexp_matches(text, '^(ACT |SCENE |PROLOGUE|EPILOGUE|INDUCTION|Dramatis Person|THE PROLOGUE|THE EPILOGUE)') OR regexp_matches(text, '^(Enter |Exeunt|Exit |Re-enter |Alarum|Flourish|Sennet|Manet|They fight|Music|Drum|Trumpet|A march|March|Retreat|Shout|Hautboys|Cornets|Thunder|Storm|Sound|Horns|Knock)') AS ours FROM m),
    sp AS (SELECT conv_id, b::BIGINT AS b, (b + size)::BIGINT AS e FROM (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY line_no) - size AS b FROM z) WHERE ours AND size > 0)"""


@query("q_editor_share", f"WITH {T}, {SPANS} SELECT t.conv_id, length(t.text)::BIGINT AS n_chars, coalesce((SELECT sum(e - b) FROM sp WHERE sp.conv_id = t.conv_id), 0)::BIGINT AS n_editor FROM t")
def _(spark, sf_dir):
    t = corpus.transcripts(spark, sf_dir)
    spans = lines.editor_spans(t, "conv_id")
    inside = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return t.join(spans, "conv_id").select("conv_id", F.length("text").cast("long").alias("n_chars"), inside.alias("n_editor"))


@query("q_author_copies", rf"""WITH {T}, {SPANS}, ht AS (SELECT * FROM t WHERE conv_id % 10 = 0), rt AS (SELECT * FROM t WHERE conv_id % 10 > 1), {windows_sql('wh', 'ht', 'conv_id', 30)}, {windows_sql('wr', 'rt', 'conv_id', 30)},
    hit AS (SELECT conv_id, pos, piece FROM wh WHERE piece IN (SELECT piece FROM wr)), fo AS (SELECT piece, min({{'c': conv_id, 'p': pos}}) AS f FROM wr WHERE piece IN (SELECT piece FROM hit) GROUP BY piece),
    sh AS (SELECT fo.piece, coalesce(sum(greatest(0, least(sp.e, f.p + 30) - greatest(sp.b, f.p))), 0) AS n FROM fo LEFT JOIN sp ON sp.conv_id = f.c GROUP BY fo.piece, f)
    SELECT count(*) AS windows, count(*) FILTER (WHERE len(regexp_extract_all(piece, '[\p{{L}}\p{{Nl}}\p{{No}}]')) >= 25) AS lettered, count(*) FILTER (WHERE len(regexp_extract_all(piece, '[\p{{L}}\p{{Nl}}\p{{No}}]')) >= 25 AND n <= 15) AS authors FROM hit JOIN sh USING (piece)""")
def _(spark, sf_dir):
    """Shared passages of 30 characters: all, those of 25 letters, and those of which the author wrote half where they first stand."""
    t = corpus.transcripts(spark, sf_dir)
    held, rest = t.where("conv_id % 10 = 0"), t.where("conv_id % 10 > 1")
    found = overlap.first_places(held, rest, 30, "conv_id")
    judged = lines.author_wrote(found, lines.editor_spans(rest, "conv_id"), "conv_id", 30)
    lettered = F.col("letters") >= 25
    return judged.agg(F.count("*").alias("windows"), F.count_if(lettered).alias("lettered"), F.count_if(lettered & F.col("authors")).alias("authors"))


CHUNKED = chunks_sql("c0", "t", "conv_id").replace("SELECT conv_id, chunk FROM (SELECT conv_id, unnest(", "SELECT conv_id, i, chunk, row_number() OVER () AS r FROM (SELECT conv_id, i, unnest(") + ", o AS (SELECT conv_id, chunk, sum(length(chunk)) OVER (PARTITION BY conv_id ORDER BY i, r) - length(chunk) AS begin FROM c0)"


@query("q_label_chunks", f"""WITH {T}, {SPANS}, lb AS (SELECT conv_id, b, e FROM (SELECT conv_id, is_label, (sum(size) OVER w - size)::BIGINT AS b, (sum(size) OVER w)::BIGINT AS e FROM z WINDOW w AS (PARTITION BY conv_id ORDER BY line_no)) WHERE is_label), {CHUNKED}
    SELECT (SELECT count(*) FROM o) AS n_chunks, count(*) AS n_label_chunks, sum(length(o.chunk))::BIGINT AS n_label_chars FROM o JOIN lb ON lb.conv_id = o.conv_id AND o.begin >= lb.b AND o.begin < lb.e""")
def _(spark, sf_dir):
    """Chunks on speaker labels: one is on a label if its first character is, and then its last must be."""
    t = corpus.transcripts(spark, sf_dir)
    return lines.label_chunks(t, "conv_id")


@query("q_nine_groups", rf"""WITH {T}, {SPANS}, lb AS (SELECT conv_id, b, e FROM (SELECT conv_id, is_label, (sum(size) OVER w - size)::BIGINT AS b, (sum(size) OVER w)::BIGINT AS e FROM z WINDOW w AS (PARTITION BY conv_id ORDER BY line_no)) WHERE is_label), {CHUNKED},
    s AS (SELECT lower(trim(replace(chunk, chr(10), ' '))) AS w, count(*) AS times FROM o WHERE conv_id % 10 > 1 GROUP BY 1 HAVING regexp_matches(w, '^\p{{L}}')),
    x AS (SELECT chunk, lower(trim(replace(chunk, chr(10), ' '))) AS w, EXISTS (SELECT 1 FROM lb WHERE lb.conv_id = o.conv_id AND o.begin >= lb.b AND o.begin < lb.e) AS label FROM o WHERE conv_id % 10 = 0)
    SELECT CASE WHEN label THEN 'speaker labels' WHEN regexp_matches(x.w, '^\p{{L}}') THEN CASE WHEN times IS NULL THEN 'word never seen' WHEN times < 10 THEN 'word seen 1 to 9 times' WHEN times < 100 THEN 'word seen 10 to 99 times' WHEN times < 1000 THEN 'word seen 100 to 999 times' ELSE 'word seen 1,000 times or more' END
        WHEN contains(chunk, chr(10)) THEN 'line breaks' WHEN x.w = '' THEN 'lone spaces' ELSE 'punctuation' END AS grp, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars FROM x LEFT JOIN s ON s.w = x.w GROUP BY 1""")
def _(spark, sf_dir):
    """Chunks of held-out transcripts: on labels, words by how often training transcripts hold them, and the rest."""
    t = corpus.transcripts(spark, sf_dir)
    return lines.chunk_groups(lines.labelled_chunks(t.where("conv_id % 10 = 0"), "conv_id"), bpe.chunk_counts(t.where("conv_id % 10 > 1")))
