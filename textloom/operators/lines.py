"""Line rules: cleaning with counted rules, headings, speaker labels and the editor's apparatus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BODY, DIRECTION, ENTRANCE, HEADING, LABEL, chunks
from .scan import lines_in_context, sums_before


def cleaned(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, text, dropped_by, edits: blank lines are dropped under a name, others edited in place in a fixed order."""
    blank = F.trim(F.translate("text", "\t", " ")) == ""
    rules = [("tab", lambda t: F.translate(t, "\t", " ")), ("trailing space", lambda t: F.rtrim(t)), ("indent", lambda t: F.regexp_replace(t, "^ (?! )", "")), ("doubled space", lambda t: F.regexp_replace(t, "(?<=[^ ]) {2,}", " "))]
    now = lines.withColumn("dropped_by", F.when(blank, "blank line"))
    edits, text = [], F.col("text")
    for name, rule in rules:
        after = rule(text)
        edits.append(F.when(~blank & (after != text), F.lit(name)))
        text = after
    return now.select("doc_id", "line_no", F.when(~blank, text).alias("text"), "dropped_by", F.array_compact(F.array(*edits)).alias("edits"))


def rule_counts(clean: DataFrame) -> DataFrame:
    """rule, n_lines."""
    named = F.concat(F.array_compact(F.array("dropped_by")), F.col("edits"))
    return clean.select(F.explode(named).alias("rule")).groupBy("rule").agg(F.count("*").alias("n_lines"))


def headings(texts: DataFrame, key: str, before: int = 3) -> DataFrame:
    """Lines at column 0 with at least `before` blank lines before them and one behind."""
    blank = lambda x: F.trim(x) == ""
    cond = ~blank(F.col("text")) & ~F.col("text").startswith(" ") & blank(F.col("down1"))
    for i in range(1, before + 1):
        cond = cond & blank(F.col(f"up{i}"))
    return lines_in_context(texts, key, before, 1).where(cond).select(key, "line_no", "text")


def marked(texts: DataFrame, key: str) -> DataFrame:
    """key, line_no, begin, size, is_last, text, is_label: a line in capitals with a full stop, behind a blank line that is not the text's first, before a line of speech."""
    after, behind, shaped = F.col("down1"), F.col("down2"), F.col("text").rlike(LABEL)
    speech = after.isNotNull() & (after != "") & ~(after.rlike(LABEL) & behind.isNotNull())
    is_label = F.coalesce(shaped & (F.col("up1") == "") & (F.col("line_no") > 2) & speech, F.lit(False))
    return lines_in_context(texts, key, 1, 2).withColumn("is_label", is_label).drop("up1", "down1", "down2")


def apparatus(texts: DataFrame, key: str) -> DataFrame:
    """key, n_chars, n_apparatus: characters of labels, headings, entrances and bracketed directions. Takes texts, or their lines (line_no, text)."""
    if "line_no" in texts.columns:
        ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
        texts = texts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    own = marked(texts, key).withColumn("ours", F.col("is_label") | F.col("text").rlike(HEADING) | F.col("text").rlike(ENTRANCE))
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ours"), F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    inside = F.aggregate(F.regexp_extract_all(rest, F.lit(DIRECTION), 0), F.lit(0), lambda n, x: n + F.length(x))
    return own.groupBy(key).agg(F.sum("size").alias("n_chars"), (F.sum(F.when(F.col("ours"), F.col("size")).otherwise(0)) + inside).alias("n_apparatus"))


def _placed(texts: DataFrame, key: str) -> DataFrame:
    """Marked lines with the places of their characters, each line's newline among its own: begin, end."""
    return marked(texts, key).withColumn("end", F.col("begin") + F.col("size"))


def editor_spans(texts: DataFrame, key: str) -> DataFrame:
    """key, spans: where the editor wrote, as disjoint (begin, end) in order: labels, headings, entrances, bracketed directions, and all before the first body heading."""
    own = _placed(texts, key)
    ours = F.col("is_label") | F.col("text").rlike(HEADING) | F.col("text").rlike(ENTRANCE)
    span = lambda b, e: F.struct(b.cast("long").alias("begin"), e.cast("long").alias("end"))
    body = F.min(F.when(F.col("text").rlike(BODY), F.col("begin")))
    whole = own.groupBy(key).agg(F.collect_list(F.when(ours & (F.col("size") > 0), span(F.col("begin"), F.col("end")))).alias("lines"), F.coalesce(body, F.lit(0)).alias("body"))
    # the i-th direction stands behind i + 1 stretches of other text and i directions
    found, rest = F.regexp_extract_all("text", F.lit(DIRECTION), 0), F.split("text", DIRECTION, -1)
    before = lambda parts, i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    where = F.transform(found, lambda x, i: span(before(rest, i + 1) + before(found, i), before(rest, i + 1) + before(found, i + 1)))
    every = texts.select(key, where.alias("directions")).join(whole, key).select(key, F.array_sort(F.concat("lines", "directions", F.filter(F.array(span(F.lit(0), F.col("body"))), lambda s: s["end"] > 0))).alias("all"))
    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    united = F.aggregate("all", empty, lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["begin"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(span(F.element_at(done, -1)["begin"], F.greatest(F.element_at(done, -1)["end"], s["end"]))))).otherwise(F.concat(done, F.array(s))))
    return every.select(key, united.alias("spans"))


def author_wrote(found: DataFrame, spans: DataFrame, key: str, width: int) -> DataFrame:
    """Adds authors: whether the editor wrote at most half of a passage at its first place (first_<key>, first_pos). No such place: the editor did."""
    at = spans.select(F.col(key).alias(f"first_{key}"), "spans")
    begin = F.col("first_pos")
    inside = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.greatest(F.lit(0).cast("long"), F.least(s["end"], begin + width) - F.greatest(s["begin"], begin)))
    return found.join(at, f"first_{key}", "left").withColumn("authors", F.coalesce(inside * 2 <= width, F.lit(False))).drop("spans")


def labelled_chunks(texts: DataFrame, key: str) -> DataFrame:
    """key, chunk, label: whether a chunk lies on a speaker label, as its first character does. One that only begins on a label is an error."""
    labels = _placed(texts, key).where("is_label").groupBy(key).agg(F.collect_list(F.struct("begin", "end")).alias("labels"))
    flat = texts.select(key, F.posexplode(chunks("text")).alias("pos", "chunk"))
    flat = sums_before(flat, key, "pos", F.length("chunk"), "begin").withColumn("end", F.col("begin") + F.length("chunk")).join(labels, key, "left")
    on = lambda at: F.coalesce(F.exists("labels", lambda s: (at >= s["begin"]) & (at < s["end"])), F.lit(False))
    first, last = on(F.col("end") - F.length("chunk")), on(F.col("end") - 1)
    return flat.select(key, "chunk", F.when(first != last, F.raise_error(F.lit("a chunk lies on a label in part"))).otherwise(first).alias("label"))


def label_chunks(texts: DataFrame, key: str) -> DataFrame:
    """n_chunks, and the chunks and characters on speaker labels."""
    return labelled_chunks(texts, key).agg(F.count("*").alias("n_chunks"), F.count_if("label").alias("n_label_chunks"), F.sum(F.when(F.col("label"), F.length("chunk"))).alias("n_label_chars"))


def chunk_groups(labelled: DataFrame, training: DataFrame) -> DataFrame:
    """grp, n_chunks, n_chars of chunks (chunk, label), in nine groups: labels; words by how often the training chunks (chunk, n) hold them; the rest by kind."""
    word = F.lower(F.trim(F.translate("chunk", "\n", " ")))
    is_word = F.regexp_like("w", F.lit(r"^\p{L}"))
    seen = training.select(word.alias("w"), "n").where(is_word).groupBy("w").agg(F.sum("n").alias("times"))
    n = F.coalesce("times", F.lit(0))
    by_count = F.when(n == 0, "word never seen").when(n < 10, "word seen 1 to 9 times").when(n < 100, "word seen 10 to 99 times").when(n < 1000, "word seen 100 to 999 times").otherwise("word seen 1,000 times or more")
    grp = F.when(F.col("label"), "speaker labels").when(is_word, by_count).when(F.contains("chunk", F.lit("\n")), "line breaks").when(F.col("w") == "", "lone spaces").otherwise("punctuation")
    counted = labelled.groupBy("chunk", "label").agg(F.count("*").alias("k")).withColumn("w", word).join(seen, "w", "left").withColumn("grp", grp)
    return counted.groupBy("grp").agg(F.sum("k").alias("n_chunks"), F.sum(F.col("k") * F.length("chunk")).alias("n_chars"))
