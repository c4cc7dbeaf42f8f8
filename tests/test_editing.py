import pytest
from pyspark.sql import functions as F

from textloom.operators import editing, lines, overlap, sampling


def raw(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return editing.opened(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "text"))


def test_one_rule_a_line(spark):
    found = raw(spark, "a\nb\nc")
    once = editing.drop(found, "doc_id", {"first": F.col("text") == "a", "none": F.lit(None).cast("boolean")})
    assert [r.dropped_by for r in once.orderBy("line_no").collect()] == ["first", None, None]
    with pytest.raises(Exception, match="line 1 of 0 removed twice: first, again"):
        editing.drop(once, "doc_id", {"again": F.col("text") < "b"}).collect()
    with pytest.raises(Exception, match="removed twice: x, y"):
        editing.drop(found, "doc_id", {"x": F.col("text") == "b", "y": F.col("line_no") == 2}).collect()


def test_exact_lines(spark):
    found = raw(spark, "a\nb\nc")
    wanted = lambda *rows: spark.createDataFrame(rows, "doc_id long, line_no long, before string, after string, rule string")
    done = editing.edit_lines(found, "doc_id", wanted((0, 2, "b", "B", "slip"))).orderBy("line_no").collect()
    assert [(r.text, r.edits) for r in done] == [("a", []), ("B", ["slip"]), ("c", [])]
    gone = editing.drop(found, "doc_id", {"x": F.col("text") == "c"})
    for lines_, row in ((found, (0, 2, "x", "B", "r")), (found, (0, 9, "b", "B", "r")), (gone, (0, 3, "c", "C", "r")), (found, (7, 1, "a", "A", "r"))):
        with pytest.raises(Exception, match=f"line {row[1]} of {row[0]} is not {row[2]}"):
            editing.edit_lines(lines_, "doc_id", wanted(row)).collect()


def test_ranges_and_ends(spark):
    found = raw(spark, "x\nContents\n a\n b\nCast\ny\nContents\nz\nCast", "Cast\nx\n\n \n")
    inside = found.withColumn("in", editing.between("doc_id", F.col("text") == "Contents", F.col("text") == "Cast")).where("in").orderBy("doc_id", "line_no")
    assert [(r.doc_id, r.line_no) for r in inside.collect()] == [(0, 2), (0, 3), (0, 4), (0, 7), (0, 8)]
    ends = found.where(F.lit(True)).withColumn("end", editing.behind_last("doc_id", ~editing.blank("text"))).where("end")
    assert [(r.doc_id, r.line_no) for r in ends.orderBy("line_no").collect()] == [(1, 3), (1, 4), (1, 5)]


@pytest.mark.parametrize("rule, before, after", [
    ("margin number", "to scorn;        4", "to scorn;"), ("margin number", "to scorn; 4", "to scorn;"), ("margin number", "                    12", "                    12"), ("tab", "a \t b\tc", "a b c"),
    ("trailing space", "a  ", "a"), ("one-space indent", " Enter", "Enter"), ("one-space indent", "  Enter", "  Enter"), ("doubled space", "a  b   c", "a b c"), ("doubled space", "_    Fear  no", "_    Fear no"),
])
def test_patterns(spark, rule, before, after):
    got = editing.edit_pattern(raw(spark, before), rule, editing.PATTERNS[rule]).first()
    assert (got.text, got.edits) == (after, [rule] * (before != after))
    kept = editing.edit_pattern(raw(spark, before), rule, editing.PATTERNS[rule], F.col("line_no") == 1).first()
    assert (kept.text, kept.edits) == (before, [])


def test_ditto_marks(spark):
    got = raw(spark, "CASSIUS, ”   ”  ”\nplain").select(editing.spelled_out(F.col("text"), F.lit("a friend.")).alias("t")).collect()
    assert [r.t for r in got] == ["CASSIUS, a friend.", "plain"]


def test_account_and_gate(spark):
    found = editing.edit_pattern(editing.drop(raw(spark, "b  b\na\nc  c "), "doc_id", {"as": F.col("text") == "a"}), "doubled space", editing.PATTERNS["doubled space"])
    assert sorted(tuple(r) for r in editing.account(found, "doc_id").collect()) == [("as", 1, 2), ("doubled space", 2, 1)]
    assert editing.gate(found, lines=F.count("*") == 3).count() == 3
    with pytest.raises(Exception, match="every line stands"):
        editing.gate(found, every_line_stands=F.count("dropped_by") == 0).collect()


def test_editor_spans(spark):
    texts = spark.createDataFrame([(0, "Title\n\nA cast\nACT I\nhe [_Exit\nnow._] goes [_so_] on\nEnter X.\n\nHAMLET.\nTo be"), (1, "no furniture"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in lines.editor_spans(texts, "doc_id").collect()}
    t = texts.first().text
    marks = lambda *parts: [(t.index(p), t.index(p) + len(p)) for p in parts]
    assert got == {0: [(0, t.index("he [")), *marks("[_Exit\nnow._]", "[_so_]", "Enter X.\n", "HAMLET.\n")], 1: [], 2: []}


def test_author_or_editor(spark):
    rest = spark.createDataFrame([(5, "x\n\nHAMLET.\nTo be or not"), (6, "x HAMLET.\nTo be or not")], "doc_id long, text string")
    held = spark.createDataFrame([(1, "HAMLET.\nTo be or not")], "doc_id long, text string")
    found = overlap.first_places(held, rest, 10, "doc_id")
    judged = {r.pos: (r.authors, r.first_doc_id, r.first_pos, r.letters) for r in lines.author_wrote(found, lines.editor_spans(rest, "doc_id"), "doc_id", 10).collect()}
    assert judged[0] == (False, 5, 3, 8) and judged[2] == (False, 5, 5, 7) and judged[3][0] and judged[10][0]


def test_chunks_on_labels(spark):
    texts = spark.createDataFrame([(0, "x\n\nHAMLET.\nTo be")], "doc_id long, text string")
    assert tuple(lines.label_chunks(texts, "doc_id").first()) == (7, 3, 8)


def test_sampler(spark):
    train = spark.createDataFrame([(0, "abab"), (1, "abac"), (2, "abad")], "doc_id long, text string")
    model = sampling.followers(train, 2)
    by = {(r.ctx, r.ch): r.n for r in model.collect()}
    assert by == {("\x01", "a"): 3, ("a", "b"): 4, ("b", "a"): 3, ("b", "\x02"): 1, ("a", "c"): 1, ("a", "d"): 1, ("c", "\x02"): 1, ("d", "\x02"): 1}
    prompts = spark.createDataFrame([(1, "a"), (2, "c"), (3, "zz"), (4, None)], "doc_id long, text string")
    go = lambda m=model, **k: {r.doc_id: (r.continuation, r.why) for r in sampling.sample(prompts, m, "doc_id", 2, 6, **k).collect()}
    assert go(temperature=0) == {1: ("bababa", "wrote 6 characters"), 2: ("", "the text ended"), 3: ("", "nothing follows"), 4: ("ababab", "wrote 6 characters")}
    assert go(temperature=0, stop="ab")[1] == ("b", "reached the stop")
    assert go(sampling.cut(model, mask_end=True), temperature=0)[2] == ("", "nothing follows")
    assert go(seed=1) == go(seed=1) and go(temperature=0.01) == go(temperature=0)
    assert {r.ch for r in sampling.cut(model, top_k=2).where("ctx = 'a'").collect()} == {"b", "c", "d"}  # ties stay
    assert {r.ch for r in sampling.cut(model, top_p=0.6).where("ctx = 'a'").collect()} == {"b"}
    for bad in ({"top_k": 0}, {"top_p": 0}, {"top_p": 1.5}):
        with pytest.raises(ValueError):
            sampling.cut(model, **bad)
    with pytest.raises(ValueError):
        go(temperature=-1)
    assert go(most=3, seed=1) == go(seed=1)  # no task holds the table: a join a step


def test_draws_follow_counts():
    choices = [("a", 5), ("b", 3), ("c", 2)]
    assert [sampling.draw(choices, 1, i) for i in range(10)] == list("aaaaabbbcc")
    thrown = [sampling.draw(choices, 0.5, int(i / 1000 * 2**32)) for i in range(1000)]
    assert [thrown.count(x) for x in "abc"] == pytest.approx([1000 * n * n / 38 for n in (5, 3, 2)], abs=2)


def test_replies_are_whole_lines(spark):
    rows = [("a\nb\nc", "wrote 5 characters", "a\nb", True), ("abc", "wrote 3 characters", "abc", False), ("a\nb", "reached the stop", "a\nb", False), ("\na\n", "the text ended", "a", False)]
    got = sampling.reply(spark.createDataFrame([r[:2] for r in rows], "continuation string, why string")).collect()
    assert [(r.reply, r.was_cut) for r in got] == [r[2:] for r in rows]
