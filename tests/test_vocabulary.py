import pytest
from pyspark.sql import functions as F

from textloom.operators import bpe, vocabulary

CHARS, MERGES = list("abc"), [("a", "b"), ("ab", "c"), ("c", "a")]


def test_vocabularies():
    assert vocabulary.vocabulary(CHARS, MERGES) == ["a", "b", "c", "ab", "abc", "ca", vocabulary.START]
    assert vocabulary.prefix(CHARS, MERGES, 6) == MERGES[:2] and vocabulary.prefix(CHARS, MERGES, 4) == []
    for chars, merges in ((list("ba"), []), (["a", "a"], []), (["ab"], []), (sorted(set(vocabulary.START)), []), (CHARS, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])):
        with pytest.raises(ValueError):
            vocabulary.vocabulary(chars, merges)
    for size in (3, 8):
        with pytest.raises(ValueError):
            vocabulary.prefix(CHARS, MERGES, size)


def test_tokenizer_files(spark, tmp_path):
    path = f"file:{tmp_path}/t.json"
    vocabulary.save(spark, path, CHARS, MERGES, {"works": 1})
    assert vocabulary.load(spark, path) == (CHARS, MERGES)
    with pytest.raises(Exception, match="(?i)exists"):
        vocabulary.save(spark, path, CHARS, MERGES, {})
    text = (tmp_path / "t.json").read_text()
    for i, (old, new) in enumerate((('"vocab_size": 7', '"vocab_size": 8'), ('"start_id": 6', '"start_id": 0'), ('"kind": "bpe"', '"kind": "char"'), ('"kind": "bpe"', '"kind": "other"'))):
        (tmp_path / f"{i}.json").write_text(text.replace(old, new))
        with pytest.raises(ValueError):
            vocabulary.load(spark, f"file:{tmp_path}/{i}.json")


def test_ids_have_guards(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "ch string, id int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert sorted(r.ch for r in vocabulary.tokens_of(ids(1, 0, 1), vocab).collect()) == ["a", "b", "b"]
    for bad in (-1, 2):
        with pytest.raises(Exception, match=f"no such id: {bad}"):
            vocabulary.tokens_of(ids(0, bad), vocab).collect()
    held = F.create_map(F.lit("a"), F.lit(0))
    assert spark.range(1).select(vocabulary.ids_of(F.lit("a"), held).alias("x")).first().x == 0
    with pytest.raises(Exception, match="not in the vocabulary: z"):
        spark.range(1).select(vocabulary.ids_of(F.lit("z"), held)).collect()


def test_streams_begin_with_start(spark, tmp_path):
    tokens = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7)], "doc_id long, pos int, token_id int")
    vocabulary.write_stream(tokens, 9, f"file:{tmp_path}/s")
    got = vocabulary.read_stream(spark, f"file:{tmp_path}/s", 9).orderBy("doc_id", "pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, 9), (1, 1, 5), (1, 2, 6), (2, 0, 9), (2, 1, 7)]
    with pytest.raises(Exception, match="no START before"):
        vocabulary.read_stream(spark, f"file:{tmp_path}/s", 8).collect()


def test_usage(spark):
    used = spark.createDataFrame([("a", 100), ("b", 9), ("ab", 50)], "token string, n long")
    assert tuple(vocabulary.usage(used, vocabulary.vocabulary(CHARS, MERGES)).first()) == (6, 1, 1, 3)


def test_spans_that_meet(spark):
    spans = [(1, 0, 3), (1, 3, 3), (1, 60, 200), (2, 5, 6), (1, 130, 131)]
    others = [(1, 2, 5), (1, 0, 300), (1, 199, 201), (1, 200, 210), (2, 6, 9), (2, 0, 6), (1, 64, 64)]
    left, right = spark.createDataFrame(spans, "k int, begin long, end long"), spark.createDataFrame(others, "k int, o_begin long, o_end long")
    got = sorted((r.k, r.begin, r.end, r.o_begin, r.o_end) for r in vocabulary.meeting(left, right, "k").collect())
    assert got == sorted((k, b, e, x, y) for k, b, e in spans for j, x, y in others if j == k and b < y and x < e and b < e and x < y)


def test_ways_a_word_is_cut(spark):
    docs = spark.createDataFrame([(0, "the cat, the cat theme")], "doc_id long, text string")
    pieces = spark.createDataFrame([(0, i, t) for i, t in enumerate(["the", " c", "at", ", t", "he", " ca", "t", " the", "me"])], "doc_id long, pos int, token string")
    got = {r.word: (r.occurrences, r.ways) for r in vocabulary.ways_to_cut(vocabulary.words_in(docs, "doc_id"), vocabulary.placed(pieces, "doc_id", "token"), "doc_id").collect()}
    assert got == {"the": (2, 2), "cat": (2, 2), "theme": (1, 1)}


def test_bits_shared_over_characters(spark):
    tokens = spark.createDataFrame([(0, 0, 0, 6.0), (0, 0, 3, 1.5), (0, 3, 4, 2.0), (0, 4, 4, 1.0), (0, 4, 6, 1.0)], "doc_id long, o_begin long, o_end long, bits double")
    got = {r["at"]: r.bits for r in vocabulary.shared_bits(tokens, "doc_id").collect()}
    assert got == {0: 6.5, 1: 0.5, 2: 0.5, 3: 2.0, 4: 1.5, 5: 0.5}


def test_merges_without_a_chunk_rule(spark):
    """A text as one chunk: runs from the left, and pieces across words."""
    whole = spark.createDataFrame([("a a a a", 1), ("aaaaa", 1)], "chunk string, n long")
    merges = bpe.learn(whole, 2)
    assert merges == [("a", "a"), ("a", " ")] and bpe.cut("aaaaa a", {m: i for i, m in enumerate(merges)}) == ["aa", "aa", "a ", "a"]
