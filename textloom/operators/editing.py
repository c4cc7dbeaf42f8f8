"""Rules that clean a text line by line, with an account of every line, and gates that stop a job before it writes.

Lines carry what happened to them: dropped_by (the rule that removes the line, null if it stays) and edits (the rules that changed it, in
order). Line numbers never shift, so rules may name lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(text: Column | str) -> Column:
    return F.trim(F.translate(text, "\t", " ")) == ""


def opened(lines: DataFrame) -> DataFrame:
    """Lines (key, line_no, text) before any rule."""
    return lines.withColumns({"dropped_by": F.lit(None).cast("string"), "edits": F.array().cast("array<string>")})


def between(key: str, begins: Column, ends: Column) -> Column:
    """Whether a line lies in a range, from a line that begins one up to the line before the next that ends one."""
    w = Window.partitionBy(key).orderBy("line_no")
    begin, end = F.last(F.when(begins, F.col("line_no")), True).over(w), F.last(F.when(ends, F.col("line_no")), True).over(w)
    return F.coalesce(begin > F.coalesce(end, F.lit(0)), F.lit(False))


def behind_last(key: str, kept: Column) -> Column:
    """Whether a line comes behind the last line of its text that is kept."""
    return F.col("line_no") > F.coalesce(F.max(F.when(kept, F.col("line_no"))).over(Window.partitionBy(key)), F.lit(0))


def drop(lines: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Drops lines under the name of their rule. A line that two rules remove, or that is gone already, is an error."""
    named = lines.withColumn("gone", F.array_compact(F.array("dropped_by", *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])))
    twice = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" of "), F.col(key).cast("string"), F.lit(" removed twice: "), F.array_join("gone", ", "))
    one = F.when(F.size("gone") > 1, F.raise_error(twice)).otherwise(F.get("gone", F.lit(0)))
    return named.withColumn("dropped_by", one).drop("gone")


def edit_lines(lines: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Replaces exact lines. wanted: key, line_no, before, after, rule. A line that does not read as expected, is gone or missing is an error."""
    to = wanted.select(key, "line_no", "before", "after", "rule", F.lit(True).alias("wanted"))
    both = lines.withColumn("there", F.lit(True)).join(to, [key, "line_no"], "full")
    reads = F.coalesce((F.col("text") == F.col("before")) & F.col("dropped_by").isNull() & F.col("there"), F.lit(False))
    wrong = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" of "), F.col(key).cast("string"), F.lit(" is not "), F.col("before"))
    new = F.when(F.col("wanted").isNull(), F.col("text")).when(reads, F.col("after")).otherwise(F.raise_error(wrong))
    done = F.when(F.col("wanted"), F.concat("edits", F.array("rule"))).otherwise(F.col("edits"))
    return both.withColumns({"text": new, "edits": done}).select(*lines.columns)


def edit_pattern(lines: DataFrame, rule: str, change: Callable[[Column], Column], but: Column | None = None) -> DataFrame:
    """Changes the lines that still stand, but those that `but` names; notes the rule where a line is another one then."""
    may = F.col("dropped_by").isNull() if but is None else F.col("dropped_by").isNull() & ~F.coalesce(but, F.lit(False))
    now = lines.withColumn("new", F.when(may, change(F.col("text"))).otherwise(F.col("text")))
    return now.withColumns({"edits": F.when(F.col("new") != F.col("text"), F.concat("edits", F.array(F.lit(rule)))).otherwise(F.col("edits")), "text": F.col("new")}).drop("new")


#: Changes of a line, by rule.
PATTERNS: dict[str, Callable[[Column], Column]] = {
    "margin number": lambda t: F.regexp_replace(t, r"(?<=\S) +\d+$", ""),
    "tab": lambda t: F.regexp_replace(t, r" ?\t ?", " "),
    "trailing space": lambda t: F.rtrim(t),
    "one-space indent": lambda t: F.regexp_replace(t, r"^ (?! )", ""),
    "doubled space": lambda t: F.regexp_replace(t, r"(?<=[^\s_]) {2,}(?=\S)", " "),
}


def spelled_out(text: Column, said: Column) -> Column:
    """Ditto marks behind a comma stand for what the line before says there."""
    return F.when(said.isNotNull(), F.regexp_replace(text, r",\s*”\s+”\s+”", F.concat(F.lit(", "), said))).otherwise(text)


def account(edited: DataFrame, key: str) -> DataFrame:
    """rule, n_lines, touch: lines each rule touched, and its turn, by the first line it touched."""
    named = edited.select(key, "line_no", F.posexplode(F.concat(F.array_compact(F.array("dropped_by")), "edits")).alias("at", "rule"))
    per = named.groupBy("rule").agg(F.count("*").alias("n_lines"), F.min(F.struct(key, "line_no", "at")).alias("first"))
    return per.select("rule", "n_lines", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")).alias("touch"))  # a row per rule


def gate(df: DataFrame, **checks: Column) -> DataFrame:
    """The same rows, if all checks (aggregates over them) hold; else the job fails before it gives a row."""
    held = [F.when(F.coalesce(c, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(name.replace("_", " ")))).alias(name) for name, c in checks.items()]
    one = df.agg(*held).select(F.array(*checks).alias("checks"))
    return df.crossJoin(F.broadcast(one)).where(F.forall("checks", lambda x: x)).drop("checks")  # one row
