import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import rules, text
from textloom.operators import bpe, lines, ngrams, overlap, selection
from textloom.sources import corpus, files

SF = "/root/testdata/sf0.001"


def inner_sd(values):
    mean = math.fsum(values) / len(values)
    return math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_chunks_by_hand(spark):
    got = [r[0] for r in docs(spark, "the old’s  2 cats, ._]\n\n  No", "", "   ").select(text.chunks("text")).collect()]
    assert got == [["the", " old’s", " ", " 2", " cats", ",", " ._]", "\n\n", " ", " No"], [], ["  ", " "]]
    with pytest.raises(Exception, match="does not cover"):
        docs(spark, "a\tb").select(text.chunks("text")).collect()


def test_plain(spark):
    assert docs(spark, "ACT I\n\nSCENE  II.   A ’tis 12 it's").select(text.plain("text")).first()[0] == "act i scene ii a tis it s"


@pytest.mark.parametrize("width", [1, 3, 50])
def test_windows_are_all_of_them(spark, width):
    texts = ["", "ab", "é" * 700 + "xyz" * 100, "q" * 256, "q" * 305]
    got = sorted(tuple(r) for r in text.windows(docs(spark, *texts), width, "doc_id").collect())
    assert got == sorted((i, p, t[p : p + width]) for i, t in enumerate(texts) for p in range(len(t) - width + 1))


def test_model_by_hand(spark):
    got = ngrams.score(docs(spark, "ac"), docs(spark, "aab"), 1, 3).first()
    assert got.n_chars == 2 and got.bits1 == pytest.approx(-math.log2((2 + 2 / 3) / 5) - math.log2((2 / 3) / 5))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_probabilities_sum_to_one(spark, order):
    train, alphabet = ["abcab", "ccab", "bb"], "abc"
    for context in ("", "a", "abca", "zzz"[:0] + "cb"):
        rows = docs(spark, *[context + c for c in alphabet])
        last = ngrams.padded(rows, order, "doc_id").where(f"pos = {len(context)}")
        p = ngrams.probabilities(last.select("piece"), ngrams.gram_counts(docs(spark, *train), order), order, 3).agg({f"p{order}": "sum"}).first()[0]
        assert p == pytest.approx(1)


def test_all_orders_at_once(spark, monkeypatch):
    dice = random.Random(9)
    text = lambda n: "".join(dice.choice("abcé 𝔘") for _ in range(n))
    train, held = docs(spark, *[text(dice.randint(0, 120)) for _ in range(30)], None, ""), docs(spark, *[text(dice.randint(0, 90)) for _ in range(12)], "x", "", None)
    for groups in ((), ("doc_id",)):
        key = lambda r: r[: len(groups)]  # noqa: E731, B023
        a, b = ({key(r): tuple(r)[len(groups) :] for r in f(held, train, 5, 7, *groups).collect()} for f in (ngrams.score, ngrams.score_orders))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("part", [3, 50])
def test_orders_across_cuts(monkeypatch, part):
    """Equal hashes for equal n-grams and contexts only, wherever long texts are cut."""
    dice = random.Random(part)
    texts = ["".join(dice.choice("abé") for _ in range(n)) for n in (0, 1, 4, 130)] + [None]
    monkeypatch.setattr(ngrams, "PART", part)
    grams, contexts, n = defaultdict(set), defaultdict(set), Counter()
    for rows, hashes in ngrams._by_order(texts, 4):
        for row in set(rows.tolist()):
            at = np.flatnonzero(rows == row)
            for i, j in enumerate(at.tolist(), start=n[row]):
                before = "\x01" * 3 + texts[row][: i + 1]
                for k in range(1, 5):
                    grams[k, before[-k:]].add(int(hashes[k - 1][0][j]))
                    contexts[k, before[-k:-1]].add(int(hashes[k - 1][1][j]))
            n[row] += len(at)
    assert dict(n) == {i: len(t) for i, t in enumerate(texts) if t}
    for found in (grams, contexts):
        assert all(len(v) == 1 for v in found.values()) and len({x for v in found.values() for x in v}) == len(found)


def glued(word, pair):
    """A word's pieces with each occurrence of the pair made one, from the left; by text, with a mark between pieces."""
    text = "\0" + "\0".join(word) + "\0"
    while (at := text.find("\0" + "\0".join(pair) + "\0")) >= 0:
        end = at + 1 + len(pair[0])
        text = text[: at + 1] + "\1" + text[at + 1 : end] + text[end + 1 :]  # \1 keeps a made piece from being taken again
    return [x.strip("\1") for x in text.strip("\0").split("\0")]


def slow_merges(texts, how_many):
    words, out = [list(t) for t in texts], []
    while len(out) < how_many:
        n = Counter(p for w in words for p in zip(w, w[1:]))
        if not n or max(n.values()) < 2:
            break
        out.append(max(n, key=lambda p: (n[p], p)))
        words = [glued(w, out[-1]) for w in words]
    return out, words


def test_merges_by_recount(spark):
    dice = random.Random(3)
    chunks = ["".join(dice.choice("aab c’_.") for _ in range(dice.randint(1, 14))).strip() or "a" for _ in range(60)]
    counted = spark.createDataFrame(list(Counter(chunks).items()), "chunk string, n long")
    merges, words = slow_merges(chunks, 30)
    assert bpe.learn(counted, 30) == merges
    coded = {r.chunk: r.pieces for r in bpe.encode_chunks(counted.select("chunk"), merges).collect()}
    assert [coded[c] for c in chunks] == words
    assert bpe.learn(spark.createDataFrame([("xyxyxyz", 2), ("xxxx", 1)], "chunk string, n long"), 9) == [("x", "y"), ("xy", "xy"), ("x", "x"), ("xyxy", "xy"), ("xyxyxy", "z")]
    pairs = {(r[0], r[1]): r[2] for r in bpe.pair_counts(counted).collect()}
    assert pairs == Counter(p for c in chunks for p in zip(c, c[1:]))


def test_encode_round_trip(spark):
    d = corpus.load_set(spark, SF, "validation")
    merges = bpe.learn(bpe.chunk_counts(d), 50)
    back = defaultdict(dict)
    for r in bpe.encode(d, merges).collect():
        back[r.doc_id][r.pos] = "".join(r.pieces)
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in back.items()} == {r.doc_id: r.text for r in d.collect()}


def test_test_set_is_locked(spark):
    with pytest.raises(PermissionError):
        corpus.load_set(spark, SF, "test")
    assert corpus.load_set(spark, SF, "test", corpus.UNLOCK).count() == 20


def test_longest_copy(spark):
    lifted = "q".join(f"{i * 7919 % 1000:03d}" for i in range(100))
    held = docs(spark, "zz" + lifted[50:350] + "##")
    assert overlap.longest(held, docs(spark, "other", lifted)) == (300, 0, 2)
    assert overlap.longest(docs(spark, "???"), docs(spark, "abc")) == (0, None, None)
    assert overlap.longest(docs(spark, "??", "xab", "ab"), docs(spark, "abc")) == (2, 1, 1)


@pytest.mark.parametrize("part", [7, 64, 1_000_000])
def test_hashed_windows_are_the_windows(spark, monkeypatch, part):
    """Equal hashes for equal windows and for no others, wherever long texts are cut; in this process, so that the cut can be moved."""
    dice = random.Random(part)
    texts = ["", None, "ab", "".join(dice.choice("abé") for _ in range(300)), "".join(dice.choice("ab") for _ in range(63 + 20)), "𝔘" * 70]
    monkeypatch.setattr(overlap, "PART", part)
    seen = {}
    for rows, begins, nexts, codes in overlap._parts(texts, 20):
        for row, begin, behind, code in zip(rows, begins, nexts, codes):
            sums = overlap.Sums(code)
            for w in (1, 3, 20):
                at = np.arange(max(0, min(len(code) - w + 1, behind - begin)))
                for i, h, g in zip(at.tolist(), sums.hashes(at, w, 0).tolist(), sums.hashes(at, w, 1).tolist()):
                    assert (row, begin + i, w) not in seen
                    seen[row, begin + i, w] = (h, g)
    want = {(row, i, w): t[i : i + w] for row, t in enumerate(texts) for w in (1, 3, 20) for i in range(len(t or "") - w + 1)}
    assert set(seen) == set(want)
    by_text = defaultdict(set)
    for k, text in want.items():
        by_text[text].add(seen[k])
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)


@pytest.mark.parametrize("most", [0, 1 << 23])
def test_shared_windows_by_text(spark, monkeypatch, most):
    """With and without the bitmap."""
    monkeypatch.setattr(overlap, "MOST", most)
    dice = random.Random(2)
    text = lambda n: "".join(dice.choice("ab ") for _ in range(n))
    held, rest = [text(60) for _ in range(8)], [text(80) for _ in range(8)]
    got = sorted(tuple(r) for r in overlap.shared(docs(spark, *held), docs(spark, *rest), [5, 8, 11], "doc_id").collect())
    assert got == sorted((d, i, w) for d, t in enumerate(held) for w in (5, 8, 11) for i in range(len(t) - w + 1) if any(t[i : i + w] in r for r in rest))
    both = held + rest
    counted = overlap.held_elsewhere(docs(spark, *both), [5, 8], "doc_id", F.col("doc_id") % 2 == 0).collect()
    for r in counted:
        at = [(d, t[i : i + r.width]) for d, t in enumerate(both) for i in range(len(t) - r.width + 1) if d % 2 == 0]
        assert (r.windows, r.shared) == (len(at), sum(any(x in t for e, t in enumerate(both) if e != d) for d, x in at))
    for r in overlap.held_elsewhere(docs(spark, *both), [5, 8], "doc_id").collect():
        at = [(d, t[i : i + r.width]) for d, t in enumerate(both) for i in range(len(t) - r.width + 1)]
        assert (r.windows, r.shared) == (len(at), sum(any(x in t for e, t in enumerate(both) if e != d) for d, x in at))


def test_labels(spark):
    cases = {"x\n\nHAMLET.\nTo be": [3], "\nHAMLET.\nTo be": [], "x\n\nI.\nYES.\nno": [], "x\n\nFirst LORD.\nHi": [], "x\n\nPRINCE & POINS.\nAy": [3], "x\n\nHAMLET.\n\nTo": []}
    for t, want in cases.items():
        assert [r.line_no for r in lines.marked(docs(spark, t), "doc_id").where("is_label").collect()] == want, t


def test_apparatus(spark):
    got = lines.apparatus(corpus.lines(docs(spark, "ACT I\nhe [_Exit\nnow._] goes\nEnter X.")), "doc_id").first()
    assert (got.n_chars, got.n_apparatus) == (36, 6 + 13 + 8)


def test_window_plan_scores_each_target_once():
    for n in (1, 15, 16, 17, 31, 100, 1000):
        for stride in (4, 8, 16):
            seen = [b + i for b, f in rules.window_plan(n, 16, stride) for i in range(f, min(16, n - b))]
            assert sorted(seen) == list(range(n))


def test_next_length(spark):
    cases = [
        ({}, 5000), ({5000: (1.78, 4900)}, 10_000), ({5000: (1.78, 4900), 10_000: (1.77, 9000)}, None), ({5000: (1.78, 100), 10_000: (1.78, 9000)}, 2500),
        ({5000: (1.0, 4999), 1250: (1.0, 0), 10_000: (1.0, 9999)}, 625), ({5000: (2.0, 4999), 10_000: (1.5, 9999)}, 20_000), ({5000: (2.0, 4999), 10_000: (1.5, 9999), 20_000: (1.6, 5000)}, None),
        ({10_000: (1.5, 10)}, 5000), ({5000: (2.0, 10), 10_000: (2.0, 10), 2500: (2.0, 10), 1250: (2.0, 10), 625: (2.0, 1)}, None),
    ]
    for tried, want in cases:
        rows = spark.createDataFrame([(n, *x) for n, x in tried.items()], "steps int, best double, best_step int")
        assert rules.next_length(rows).first()[0] == want, tried


def test_learning_rate(spark):
    got = [r[0] for r in spark.range(0, 31, 5).select(rules.learning_rate(F.col("id"), 10, 30, 1.0, 0.1)).collect()]
    assert got == pytest.approx([0.1, 0.6, 1.0, 0.1 + 0.45 * (1 + math.cos(math.pi / 4)), 0.55, 0.1 + 0.45 * (1 + math.cos(math.pi * 3 / 4)), 0.1])


def test_bootstrap_of_equal_blocks(spark):
    rows = [(d, b, 2.0, 4) for d in range(2) for b in range(3)]
    got = selection.bootstrap(spark.createDataFrame(rows, "doc_id int, block int, bits double, chars int"), 50).first()
    assert (got.low, got.high) == (0.5, 0.5)


def test_pooled_sd(spark):
    rows = [("a", 1, s, x) for s, x in enumerate((1.0, 1.2, 1.4))] + [("b", 2, s, x) for s, x in enumerate((2.0, 2.1))]
    got = selection.pooled(selection.groups(spark.createDataFrame(rows, "arm string, parameters int, seed int, best double"))).first()
    want = math.sqrt((2 * inner_sd([1.0, 1.2, 1.4]) ** 2 + inner_sd([2.0, 2.1]) ** 2) / 3)
    assert got.pooled_sd == pytest.approx(want) and got.df == 3


def test_normaliser():
    alphabet = frozenset("abcdefghijklmnopqrstuvwxyz ’“”—\n")
    assert text.normalised('say "hi" it\'s', alphabet) == ("say “hi” it’s", ['" (quotation mark, U+0022) -> “ (left double quotation mark, U+201C)', '" (quotation mark, U+0022) -> ” (right double quotation mark, U+201D)', "' (apostrophe, U+0027) -> ’ (right single quotation mark, U+2019)"])
    assert text.normalised("a\tb\u200bc", alphabet) == ("a bc", ["U+0009 -> space, U+0020", "zero width space, U+200B left out"])
    assert text.normalised("a\r\nb\tc\xad –  ", alphabet)[0] == "a\nb c —"
    assert text.normalised("a\u200b\"", alphabet)[0] == "a”" and text.normalised('"', alphabet | {'"'}) == ('"', [])  # the alphabet is asked first
    assert text.normalised("a ", alphabet) == ("a", ["cut off at the end: 1 x U+0020"])
    for bad, why in (("ñ", "nearest letter there is 'n'"), ("日", "not in the alphabet$"), ("", "empty"), ("  ", "empty")):
        with pytest.raises(ValueError, match=why):
            text.normalised(bad, alphabet)


def test_sinks(spark, tmp_path):
    one = docs(spark, "x")
    corpus.append_attempt(one, str(tmp_path / "a"))
    corpus.append_attempt(one, str(tmp_path / "a"))
    said = spark.read.json(str(tmp_path / "a")).collect()
    assert len(said) == 2 and all(datetime.fromisoformat(r["at"]).utcoffset() == timedelta(0) for r in said)
    corpus.write_once(one, str(tmp_path / "b"))
    with pytest.raises(Exception, match="(?i)exists"):
        corpus.write_once(one, str(tmp_path / "b"))


def test_texts_are_what_was_recorded(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "s") for i in range(0, 40, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    manifest = corpus.load_set(spark, str(tmp_path), "validation").select("doc_id", "sha256")
    read = lambda m: sorted(r.text for r in corpus.load_set(spark, str(tmp_path), "validation", manifest=m).select("text").collect())
    assert read(manifest) == [f"text {i}" for i in range(0, 40, 10)]
    with pytest.raises(Exception, match="document 20 is not what was recorded"):
        read(manifest.withColumn("sha256", F.when(F.col("doc_id") == 20, F.sha2(F.lit("text 2O").cast("binary"), 256)).otherwise(F.col("sha256"))))
    with pytest.raises(Exception, match="document 30 has no checksum on record"):
        read(manifest.where("doc_id < 30"))


def test_swap_in(spark, tmp_path):
    path = f"file:{tmp_path}/table"
    files.swap_in(docs(spark, "a"), path)
    files.swap_in(docs(spark, "b", "c"), path)
    assert [r.text for r in files.current(spark, path).orderBy("doc_id").collect()] == ["b", "c"] and len([p for p in (tmp_path / "table").iterdir() if p.is_dir()]) == 1
    with pytest.raises(Exception, match="no such luck"):
        files.swap_in(docs(spark, "d").withColumn("text", F.raise_error(F.lit("no such luck"))), path)
    assert files.current(spark, path).count() == 2


def test_a_crash_before_the_pointer_swings_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file:{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        files.current(spark, path)
    files.swap_in(docs(spark, "a"), path)
    monkeypatch.setattr(files, "replace", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        files.swap_in(docs(spark, "b"), path)
    assert [r.text for r in files.current(spark, path).collect()] == ["a"]
    monkeypatch.undo()
    files.swap_in(docs(spark, "c"), path)
    assert [r.text for r in files.current(spark, path).collect()] == ["c"]


def test_a_crash_before_the_result_stands_leaves_the_claim(spark, tmp_path, monkeypatch):
    path = f"file:{tmp_path}/final.json"
    files.claim(spark, path, {"begun": True})
    monkeypatch.setattr(files, "replace", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        files.complete(spark, path, {"score": 1.5})
    with pytest.raises(Exception, match="(?i)exists"):
        files.claim(spark, path, {})
    monkeypatch.undo()
    files.complete(spark, path, {"score": 2.5})
    assert spark.read.json(path).first().score == 2.5


def test_one_way_door(spark, tmp_path):
    path = f"file:{tmp_path}/final.json"
    with pytest.raises(FileNotFoundError):
        files.complete(spark, path, {})
    files.claim(spark, path, {"begun": True})
    with pytest.raises(Exception, match="(?i)exists"):
        files.claim(spark, path, {})
    files.complete(spark, path, {"score": 1.5})
    assert spark.read.json(path).first().score == 1.5


def test_files_are_what_a_manifest_says(spark, tmp_path):
    import hashlib

    for name, text in (("a.txt", "eins\n"), ("b.txt", "zwei")):
        (tmp_path / name).write_text(text)
    row = lambda name, text: (name, hashlib.sha256(text.encode()).hexdigest())
    manifest = lambda *rows: spark.createDataFrame(rows, "file string, sha256 string")
    got = files.verified(spark, str(tmp_path), manifest(row("a.txt", "eins\n"), row("b.txt", "zwei"))).orderBy("file").collect()
    assert [tuple(r) for r in got] == [("a.txt", "eins\n"), ("b.txt", "zwei")]
    for bad, why in ((row("a.txt", "other"), "not what was recorded"), (row("c.txt", ""), "c.txt is missing")):
        with pytest.raises(Exception, match=why):
            files.verified(spark, str(tmp_path), manifest(bad)).collect()


def test_run_folders(spark, tmp_path):
    base = {"arm": "x", "seed": 1, "steps": 10, "parameters": 5, "git_commit": "c", "sixteen_bit": False, "vocabulary": 9}
    done = {"best": {"validation_bpc": 1.5, "step": 7, "passes": 1.0, "seen_bpc": 1.0}, "final_validation_bpc": 1.6, "minutes": 2.0}
    files.write_runs(spark, f"file:{tmp_path}", [
        {"config.json": {**base, "name": "a-1"}, "result.json": done, "evaluation-best.json": {"everything_else": {"bits_per_character": 1.4}}, "DIVERGED": "", "log.csv": "step,passes,learning_rate,training_loss,validation_bpc,tokens_per_second\n0,0.0,0.1,nan,6.6,nan\n"},
        {"config.json": {**base, "name": "a-2"}, "DIVERGED": ""}, {"config.json": {**base, "name": "a-3"}, "last.pt": ""}, {"config.json": {**base, "name": "b"}},
    ])
    got = {r.run: (r.best, r.everything_else, r.state, r.diverged) for r in files.read_runs(spark, f"file:{tmp_path}").collect()}
    assert got == {"a-1": (1.5, 1.4, "done", True), "a-2": (None, None, "diverged", True), "a-3": (None, None, "interrupted", False), "b": (None, None, "to do", False)}
    assert {r.run for r in files.read_runs(spark, f"file:{tmp_path}", "a-").collect()} == {"a-1", "a-2", "a-3"} and files.read_runs(spark, f"file:{tmp_path}", "none").count() == 0
    row = files.read_logs(spark, f"file:{tmp_path}").first()
    assert (row.run, row.step, row.validation_bpc) == ("a-1", 0, 6.6) and math.isnan(row.training_loss) and math.isnan(row.tokens_per_second)


def test_no_verdict_before_all_is_done(spark):
    rows = [(a, i, s, 1.0 + i + s / 100, "done", False) for i, a in enumerate("ab") for s in (1, 2, 3)]
    run = lambda *more: spark.createDataFrame([*rows, *more], "arm string, parameters int, seed int, best double, state string, diverged boolean")
    told = lambda df: (selection.verdicts(selection.groups(df), selection.complete(df)).first().verdict, selection.choice(selection.groups(df), selection.complete(df)).first().chosen)
    assert told(run()) == ("DIFFERENT", "a") and told(run(("a", 0, 4, None, "diverged", True)))[0] == "DIFFERENT"
    for more in (("a", 0, 4, 1.0, "done", False), ("b", 1, 4, None, "interrupted", False), ("b", 1, 4, None, "to do", False)):
        assert told(run(more)) == ("PARTIAL", None)


def test_borrowed_lengths(spark):
    found = lambda **k: spark.createDataFrame(list(k.items()), "arm string, steps int")
    got = rules.borrowed(found(a=4000, b=8000, c=10), {"x": "a"}, ("a", "b")).collect()
    assert {tuple(r) for r in got} == {("a", 4000, "a"), ("b", 8000, "b"), ("c", 10, "c"), ("x", 4000, "a")}
    for bad in ({"a": 4000, "b": 8001}, {"a": 4000}):
        with pytest.raises(Exception, match="search these lengths"):
            rules.borrowed(found(**bad), {"x": "a"}, ("a", "b")).collect()


def test_more_than_one_passage_is_an_error(spark):
    item, text = "".join(chr(0x400 + i) for i in range(60)), "".join(chr(0x4E00 + i) for i in range(60))
    one = overlap.passages(docs(spark, item), docs(spark, "??" + item).withColumnRenamed("doc_id", "other"), 20, "doc_id", "other")
    assert overlap.only_one(one, "doc_id", "other").first().length == 60
    two = overlap.passages(docs(spark, item + "#" + text), docs(spark, text + "?" + item).withColumnRenamed("doc_id", "other"), 20, "doc_id", "other")
    with pytest.raises(Exception, match="2 passages of 0 and 0"):
        overlap.only_one(two, "doc_id", "other").collect()


def test_longest_of_each(spark):
    held, rest = ["the cat sat on the mat", "a dog", "zzzz", "", "the cat sat"], ["see the cat sat down", "on the mat", "a dig"]
    want = {d: max((n for n in range(len(t) + 1) for i in range(len(t) - n + 1) if any(t[i : i + n] in r for r in rest)), default=0) for d, t in enumerate(held)}
    assert {r.doc_id: r.longest for r in overlap.longest_of_each(docs(spark, *held), docs(spark, *rest), "doc_id", cap=40).collect()} == want
