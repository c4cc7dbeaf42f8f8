"""Steps that grew faster than their input, or met in one task: the same results by the step that replaced them."""

from __future__ import annotations

import lzma
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import bpe, ngrams, overlap, selection
from textloom.sources import arrays


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def some_texts(seed, n, most, letters="abcé 𝔘"):
    dice = random.Random(seed)
    return ["".join(dice.choice(letters) for _ in range(dice.randint(0, most))) for _ in range(n)]


def test_resamples_are_drawn_by_many_tasks(spark):
    blocks = spark.createDataFrame([(d, b, 1.0 + d + b, 10) for d in range(8) for b in range(3)], "doc_id long, block long, bits double, chars long")
    got = selection.bootstrap(blocks, 50)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().optimizedPlan().toString() or "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < got.first().low <= got.first().high


@pytest.mark.parametrize("counted", [7, 1000])
def test_orders_by_block(spark, monkeypatch, counted):
    """Along texts and by block, wherever parts of texts end, as by joins."""
    monkeypatch.setattr(ngrams, "COUNTED", counted)
    train, held = docs(spark, *some_texts(1, 20, 60), None, ""), docs(spark, *some_texts(2, 9, 70), None, "")
    key = lambda r: (r.doc_id, r.block)
    a, b = ({key(r): tuple(r)[2:] for r in f(held, train, 3, 7, "doc_id", block=20).collect()} for f in (ngrams.score_orders, ngrams._joined))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_each_width_has_its_own_sieve(spark):
    """Where all texts share short windows, wide ones that the held side lacks leave before the shuffle."""
    held, corpus = docs(spark, "abababXYZabab"), docs(spark, *("ab" * 40 + "cd" * i for i in range(30)))
    sieve = overlap.sieve_of(overlap.hashed(held, [2, 9]), [2, 9], 100)
    assert overlap.hashed(corpus, [2, 9], sieve=sieve).where("width = 9").count() < 30  # by the least width alone: all 2,000
    got = overlap.shared(held, corpus, [2, 6, 9], "doc_id").groupBy("width").count()
    assert {r[0]: r[1] for r in got.collect()} == {2: 8, 6: 1}


def test_equal_windows_of_a_part_leave_once(spark):
    corpus = docs(spark, "ab" * 500, "ab" * 500)
    assert overlap.hashed(corpus, [3, 20], once=True).count() <= 2 * 2 * corpus.rdd.getNumPartitions() < overlap.hashed(corpus, [3, 20]).count()


@pytest.mark.parametrize("counted", [4, 1000])
def test_pairs_inside_texts(spark, monkeypatch, counted):
    monkeypatch.setattr(ngrams, "COUNTED", counted)
    texts = some_texts(5, 12, 30, "ab\0é𝔘")
    got = {r.piece: r.n for r in ngrams.counted(docs(spark, *texts, None, "", "a"), 2, pad="").collect()}
    assert got == Counter(t[i : i + 2] for t in texts for i in range(len(t) - 1))


@pytest.mark.parametrize("group", [50, 1 << 20])
def test_beyond_a_bitmap_windows_meet_as_stretches(spark, monkeypatch, group):
    """The same windows by stretches of text as by rows of hashes, wherever parts of texts end."""
    held = docs(spark, *some_texts(3, 12, 150, "abé 𝔘"), "x" * 300, None, "", "a1" * 40)
    corpus = docs(spark, *some_texts(4, 40, 150, "abé 𝔘"), *some_texts(3, 12, 150, "abé 𝔘")[4:8], "y" + "x" * 90, None, "a1" * 30)
    rows = lambda df: sorted(map(tuple, df.collect()))
    widths = [3, 9, 12, 30, 70]
    want = [rows(overlap.shared(held, corpus, ws, "doc_id")) for ws in (widths, [20])]
    longest, curve = overlap.longest(held, corpus), rows(overlap.curve(held, corpus, widths, "doc_id"))
    monkeypatch.setattr(overlap, "MOST", 10)
    monkeypatch.setattr(overlap, "PART", 70)
    monkeypatch.setattr(overlap, "GROUP", group)
    assert [rows(overlap.shared(held, corpus, ws, "doc_id")) for ws in (widths, [20])] == want and all(want)
    assert overlap.longest(held, corpus) == longest and rows(overlap.curve(held, corpus, widths, "doc_id")) == curve


def test_stretches_are_shorter_than_rows_of_windows(spark):
    text = docs(spark, *some_texts(8, 3, 60_000, "abcdé "))
    windows = overlap.hashed(text, [50]).count()
    packed = overlap.stretches(text, [50], 8, told=False).selectExpr("sum(octet_length(codes) + octet_length(sizes)) AS n").first()[0]
    assert packed < 8 * windows  # a row of two hashes and a width has 20


def test_letters_and_first_places_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART", 40)
    mine, theirs = some_texts(6, 8, 80, "aé1 "), some_texts(7, 9, 80, "aé1 ")
    held, corpus = docs(spark, *mine, None), docs(spark, None, *theirs)
    cut = lambda t: [(i, t[i : i + 5]) for i in range(len(t) - 4)]
    first = {}
    for d, t in enumerate(theirs, 1):
        for i, piece in cut(t):
            first.setdefault(piece, (d, i))
    want = sorted((d, i, sum(map(str.isalpha, x)), *first[x]) for d, t in enumerate(mine) for i, x in cut(t) if x in first)
    assert sorted(map(tuple, overlap.first_places(held, corpus, 5, "doc_id").collect())) == want and want
    own = [x for t in mine for _, x in cut(t) if sum(map(str.isalpha, x)) >= 3]
    assert tuple(overlap.lettered(held, corpus, 5, 3).first()) == (len(own), sum(x in first for x in own))


def test_held_elsewhere_with_null_keys(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART", 50)
    texts = [(i % 5 or None, t, i % 3 != 0) for i, t in enumerate(some_texts(9, 30, 90, "ab ") * 2)]
    df = spark.createDataFrame(texts, "doc_id long, text string, counted boolean")
    for w, n, shared in overlap.held_elsewhere(df, [4, 9, 20], "doc_id", df.counted).collect():
        of = {}
        for d, t, counted in texts:
            for i in range(len(t) - w + 1):
                of.setdefault(t[i : i + w], []).append((d, counted))
        many = [x for x in of.values() if len({d for d, _ in x} - {None}) > 1]
        assert (n, shared) == (sum(c for x in of.values() for _, c in x), sum(c for x in many for _, c in x))


@pytest.mark.parametrize("counted", [6, 1000])
@pytest.mark.parametrize("sent", [0, 1000])
def test_agreement_along_texts(spark, monkeypatch, counted, sent):
    """Wherever parts of texts end, and whether the table is sent or joined."""
    monkeypatch.setattr(ngrams, "COUNTED", counted)
    monkeypatch.setattr(ngrams, "SENT", sent)
    texts = ["ababababab", "", None, "xxababab", "abababababx", "b", "ab" * 20]
    best = spark.createDataFrame([("\x01\x01", "a"), ("\x01a", "b"), ("ab", "a"), ("ba", "b")], "ctx string, next string")
    agreed = lambda t: [dict(zip(["\x01\x01", "\x01a", "ab", "ba"], "abab")).get(("\x01\x01" + t)[i : i + 2]) == c for i, c in enumerate(t)]
    got = {r.doc_id: (r.n, r.agreed) for r in ngrams.agreement(docs(spark, *texts), best, "doc_id").collect()}
    assert got == {i: (len(t), sum(agreed(t))) for i, t in enumerate(texts) if t}
    runs = []
    for i, t in enumerate(texts):
        marks = "".join(" x"[x] for x in agreed(t or ""))
        runs += [(i, m.start(), len(m[0])) for m in re.finditer("x+", marks) if len(m[0]) >= 4]
    assert sorted(map(tuple, ngrams.agreement(docs(spark, *texts), best, "doc_id", 4).collect())) == runs and len(runs) > 3


def test_xz_with_a_fitted_dictionary():
    from textloom.plans.texts import _xz

    for text in (b"", b"a", *(t.encode() for t in some_texts(3, 5, 3000)), b"ab" * 700_000):
        assert _xz(text) == len(lzma.compress(text, preset=9 | lzma.PRESET_EXTREME))


def test_small_arrays_share_partitions(spark, tmp_path):
    arrays.register(spark)
    rows = spark.createDataFrame([(f"t{i}", p, float(i)) for i in range(40) for p in range(3)], "name string, pos long, value double").coalesce(1)
    rows.write.format("arrays").mode("append").save(str(tmp_path / "a"))
    got = spark.read.format("arrays").load(str(tmp_path / "a"))
    assert got.rdd.getNumPartitions() == 1  # one for each file before
    assert sorted(got.collect()) == sorted(rows.collect())


def test_words_are_one_class_of_characters(spark):
    """The chunk rule without a group for each letter, which cost a step of recursion a character: the same chunks, and no limit on a word's length."""
    from textloom.functions import text

    old = text.CHUNK.replace("[\\p{L}\\p{Nl}\\p{No}’]+", rf"(?:{text.LETTER}|’)+", 1)
    df = docs(spark, *some_texts(12, 60, 200, "aé’ 1²Ⅷ.,\n-𝔘"), "x  y’s   Ⅷ12 …\n\n  z", "")
    for r in df.select(text.chunks("text").alias("a"), F.regexp_extract_all("text", F.lit(old), F.lit(0)).alias("b")).collect():
        assert r.a == r.b
    assert old != text.CHUNK and df.sparkSession.createDataFrame([("a" * 300_000,)], "text string").select(F.size(text.chunks("text"))).first()[0] == 1


def recounted(texts, how_many):
    rows, merges = [(list(t), n) for t, n in texts], []
    while len(merges) < how_many:
        found = Counter()
        for row, n in rows:
            for pair in zip(row, row[1:]):
                found[pair] += n
        most = max(found.values(), default=0)
        if most < 2:
            break
        merges.append(min((p for p in found if found[p] == most), key=bpe._last_first))
        after = []
        for row, n in rows:
            out, i = [], 0
            while i < len(row):
                step = 2 if tuple(row[i : i + 2]) == merges[-1] else 1
                out.append("".join(row[i : i + step]))
                i += step
            after.append((out, n))
        rows = after
    return merges


@pytest.mark.parametrize("letters", ["abcdé  𝔘", "aab", "a"])
def test_merges_along_whole_texts_take_few_passes(spark, monkeypatch, letters):
    """Guessed on a third of the texts, with room for few pairs too: those of a recount, many a pass."""
    dice = random.Random(letters)
    words = ["".join(dice.choices(letters, k=dice.randint(1, 6))) for _ in range(60)]
    texts = list({"".join(dice.choices(words, k=150)): dice.randint(1, 3) for _ in range(40)}.items())
    counted, want, passes, changes = spark.createDataFrame(texts, "chunk string, n long"), recounted(texts, 100), [], bpe.changes
    monkeypatch.setattr(bpe, "changes", lambda *args: passes.append(1) or changes(*args))
    assert bpe.learn_along(counted, 100, sample=6000) == want and len(passes) <= len(want) // 4 + 2
    assert bpe.learn_along(counted, 30, sample=500, most_pairs=5) == want[:30]
    assert bpe.learn_along(counted.limit(0), 5) == []


def by_hand(held, train, order, alphabet):
    """bits of each order, summed over these texts."""
    grams, kinds, out = [Counter() for _ in range(order + 1)], [{} for _ in range(order + 1)], [0.0] * order
    for t in train:
        for i in range(len(t or "")):
            for k in range(1, order + 1):
                gram = ("\x01" * order + t)[i + order - k + 1 : i + order + 1]
                grams[k][gram] += 1
                kinds[k].setdefault(gram[:-1], Counter())[gram[-1]] += 1
    for t in held:
        for i in range(len(t or "")):
            p = 1 / alphabet
            for k in range(1, order + 1):
                gram = ("\x01" * order + t)[i + order - k + 1 : i + order + 1]
                if seen := kinds[k].get(gram[:-1]):
                    p = (grams[k][gram] + len(seen) * p) / (sum(seen.values()) + len(seen))
                out[k - 1] -= math.log2(p)
    return out


@pytest.mark.parametrize("counted, held_rows, sent", [(7, 9, 10**6), (10**6, 10**6, 10**6), (50, 40, 400)])
@pytest.mark.parametrize("letters", ["abcé 𝔘", "".join(map(chr, range(0x4E00, 0x4F40)))])
def test_long_orders_meet_by_context(spark, monkeypatch, counted, held_rows, sent, letters):
    """As by hand, wherever parts of texts end, however often tasks send what they counted, in one word or in two, behind a shorter table too."""
    for name, value in (("COUNTED", counted), ("HELD", held_rows), ("SENT", sent), ("PER_PART", 200)):
        monkeypatch.setattr(ngrams, name, value)
    train = [*(x[:9] * 3 + x for x in some_texts(31, 25, 60, letters)), None, ""]
    held = [*(x[:9] * 2 + x for x in some_texts(31, 9, 60, letters)), *some_texts(32, 5, 40, letters + "xy\0"), "", None, None]
    df, rows = docs(spark, *held).withColumn("of", F.expr("CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END")), docs(spark, *train)
    assert ngrams.Packed(ngrams.np.arange(len(set("".join(filter(None, train)))) + 1), 8).words == (1 if len(letters) == 6 else 2)
    for r in ngrams.score_orders(df, rows, 8, 9, "of").collect():
        own = [t for i, t in enumerate(held) if (i % 3 or None) == r.of]
        assert r.n_chars == sum(len(t or "") for t in own) and list(r)[2:] == pytest.approx(by_hand(own, train, 8, 9))
    assert list(ngrams.score_orders(df, rows, 8, 9).first())[1:] == pytest.approx(by_hand(held, train, 8, 9))
    assert list(ngrams.score_orders(df, rows.limit(0), 4, 9).first())[1:] == pytest.approx(by_hand(held, [], 4, 9))


def test_a_task_sends_each_long_ngram_once(spark):
    """What is shuffled grows with the different n-grams of a task, not with its characters."""
    packed = ngrams.Packed(ngrams.np.array([ord("a"), ord("b"), 1]), 8)
    size = lambda times: ngrams._packed(docs(spark, *["ab" * 500] * times).coalesce(1), packed, 3, 5).agg(F.sum(F.length("words"))).first()[0]
    assert size(1) == size(40) == 8 * 9  # 9 different ones, with those at the beginning


@pytest.mark.parametrize("part", [70, 10**6])
def test_few_windows_are_sent_to_the_corpus(spark, monkeypatch, part):
    """Windows that are sent in several turns are those that both sides hold; no row of a window leaves the corpus."""
    monkeypatch.setattr(overlap, "PART", part)
    monkeypatch.setattr(overlap, "MOST", 400)
    held = [*some_texts(3, 6, 60, "abé 𝔘"), "x" * 30, None, "", "a1" * 20]
    rest = [*some_texts(4, 20, 90, "abé 𝔘"), *some_texts(3, 6, 60, "abé 𝔘")[3:5], "y" + "x" * 25, None, "a1" * 12]
    turns, told = [], overlap._told_by
    monkeypatch.setattr(overlap, "_told_by", lambda *args: turns.append(1) or told(*args))
    monkeypatch.setattr(overlap, "_met", None)
    has = lambda x: any(x in (t or "") for t in rest)
    want = lambda ws: sorted((i, p, w) for i, t in enumerate(held) for w in ws(i) for p in range(len(t or "") - w + 1) if has(t[p : p + w]))
    got = overlap.shared(docs(spark, *held), docs(spark, *rest), [1, 3, 9], "doc_id").collect()
    assert sorted(map(tuple, got)) == want(lambda i: [1, 3, 9]) and len(turns) > 1
    asked = docs(spark, *held).withColumn("middle", (F.col("doc_id") % 2 * 4 + 3).cast("int"))
    got = overlap.shared(asked, docs(spark, *rest), [3, 7], "doc_id", "middle", only="middle").select("doc_id", "pos", "width").collect()
    assert sorted(map(tuple, got)) == want(lambda i: [i % 2 * 4 + 3])
    monkeypatch.setattr(overlap, "MOST", 10**6)
    longest = {r.doc_id: r.longest for r in overlap.longest_of_each(docs(spark, *held), docs(spark, *rest), "doc_id", cap=21).collect()}
    assert longest == {i: max((w for w in range(1, 22) for p in range(len(t or "") - w + 1) if has(t[p : p + w])), default=0) for i, t in enumerate(held)}


def test_texts_of_many_lengths_ask_few_widths(spark, monkeypatch):
    asked, shared = [], overlap.shared
    monkeypatch.setattr(overlap, "shared", lambda held, corpus, widths, *keep, **more: asked.append(len(widths)) or shared(held, corpus, widths, *keep, **more))
    overlap.longest_of_each(docs(spark, *("z" * n for n in range(41))), docs(spark, "ab"), "doc_id", cap=40)
    assert asked[0] == 6 and len(asked) <= 6  # 1, 2, 4 .. 32; 20 widths at once before
