"""Each method on the inputs that are hardest on it: long white space, other partitionings, repeated attempts, dense lists."""

import os
import random
import subprocess
import sys
from array import array

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import hmm, packing, similar, simhash, token_counts, tokens, warc
from textloom.llm.common import fresh, spread

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("gap", [" ", "\t", "\n", "　"])
def test_millions_of_white_space(spark, gap):
    text = "a" + gap * 3_000_000 + "x"
    for path in (BYTES, WORDS):
        want = array("I", Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids).tobytes()
        assert tokens.Encoder(path).encode([text]) == [want]


def test_an_encoder_is_small():
    """A worker keeps its encoder for as long as it lives, next to what other stages hold."""
    code = f"""
import re, sys, public_tokenizers, numpy, pyarrow
from textloom.llm import tokens
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
before = held()
enc = tokens.Encoder({BYTES!r})
enc.encode(["some words"])
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, check=True).stdout
    assert float(out) < 50  # 109 MB with the library and a pattern of 100,000 repeats


def test_packing_of_long_white_space(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000 + "x"), (2, "short")], "doc_id long, text string")
    got = packing.pack_documents(docs, BYTES).where("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert got[0] == got[1] == len(Tokenizer.from_file(BYTES).encode(" " * 1_000_000 + "x", add_special_tokens=False).ids) + 1


# ---- token counts


@pytest.mark.parametrize("name", ["periodic", "periods", "letters", "wide", "mixed"])
def test_long_texts_without_white_space(name):
    """Chunks whose maps are not constant: phases that never meet, and characters of many kinds and bytes across the cuts."""
    dice = random.Random(3)
    wide = [chr(c) for c in range(0x4E00, 0x9FA5)]
    text = {
        "periodic": "x" * 100_001, "periods": "".join(x * dice.randint(1, 3000) for x in ("abc", "x", "don't", "é", "日本", "'s") * 20), "letters": "".join(dice.choice("etaoinsh") for _ in range(20_000)),
        "wide": "".join(dice.choice(wide) for _ in range(20_000)), "mixed": "".join(dice.choice(["e", "t", "é", "日", "𝔘", "ß", "İ", "'", "1", ".", "\u3000", "\u00a0", "<|endoftext|>"] + ["th"] * 30) for _ in range(20_000)),
    }[name]
    lib = Tokenizer.from_file(WORDS)
    texts = [text, "a b", text[1:], "", text[: len(text) // 2]]
    assert token_counts.Transducer(WORDS).counts(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tables_have_bounded_room():
    """20,000 kinds of characters; and hardly any room, so that states are dropped in the middle of a text."""
    dice, lib = random.Random(4), Tokenizer.from_file(WORDS)
    wide = "".join(chr(dice.randrange(0x4E00, 0x9FA5)) for _ in range(40_000))
    for most, text in ((30_000, wide), (300, "".join(dice.choice("etaoin é") for _ in range(9000)) + "x" * 2000)):
        machine = token_counts.Transducer(WORDS, most=most)
        assert machine.counts([text]).tolist() == [len(lib.encode(text, add_special_tokens=False).ids)]
        assert len(machine.next) <= max(most, 1024) * machine.width and machine.width <= 256 and machine.most == most


# ---- SimHash


def test_each_two_bytes_are_left_out_together():
    assert len(simhash.LEFT_OUT) == 11 and all(any({i, j} <= set(t) for t in simhash.LEFT_OUT) for i in range(8) for j in range(i))


def test_the_tally_rejects():
    base = 0x0123456789ABCDEF
    members = np.array([base, base ^ 0x010101, base ^ 0x0101, base ^ 0x03, base ^ 0x0F], dtype=np.int64)  # 3, 2, 1, 1 bytes apart
    pairs = set(zip(*(x.tolist() for x in simhash.tallied(members))))
    assert (0, 1) not in pairs and {(0, 2), (0, 3), (0, 4)} <= pairs
    links = set(zip(*(x.tolist() for x in simhash._links(members))))
    assert {(0, 2), (0, 3)} <= links and (0, 4) not in links  # four bits in one byte pass the tally and fail the check


@pytest.mark.parametrize("bits", [16, 24])
def test_long_lists_are_divided(bits):
    """Lists beyond the pairwise size give the components of all pairs."""
    dice = random.Random(bits)
    members = np.array(sorted({dice.getrandbits(9) << bits - 9 | dice.getrandbits(6) for _ in range(1500)}), dtype=np.int64)
    x = np.bitwise_count((members[:, None] ^ members[None, :]).view(np.uint64)) <= 2
    i, j = simhash._links(members)
    assert x[i, j].all()
    found = np.zeros_like(x)
    found[i, j] = found[j, i] = True
    np.fill_diagonal(x, False)
    assert (found == x).all()


# ---- similar sets


def test_no_similar_pair_is_without_a_common_key():
    """Pairs at the bound: subsets of four fifths, and sets with equally many replaced."""
    dice, positions = np.random.default_rng(5), similar.Positions(0.8)
    for _ in range(6000):
        n = int(dice.integers(4, dice.choice([8, 20, 100, 900])))
        large = np.unique(dice.integers(0, 1 << 64, n, dtype=np.uint64))
        if dice.random() < 0.5:
            small = np.sort(dice.permutation(large)[: -(-len(large) * 4 // 5)])
        else:
            gone = int(dice.integers(0, n // 9 + 1))
            small = np.unique(np.concatenate([dice.permutation(large)[gone:], dice.integers(0, 1 << 64, gone, dtype=np.uint64)]))
        common = len(np.intersect1d(small, large))
        if common == len(small) == len(large) or common * 10 < 8 * (len(small) + len(large) - common):
            continue
        (a, one), (b, two) = positions.keys(small), positions.keys(large)
        assert len(np.intersect1d(a, b)) > max(one, two)


def test_more_positions_for_larger_sets():
    positions = similar.Positions(0.8)
    for c in range(10):
        cuts, p, d, t = positions._grid(c)
        assert (np.diff(p) >= 0).all() and (p >= d + t).all() and (np.diff(t) >= 0).all() and p[-1] <= len(cuts)


@pytest.mark.parametrize("short", [4, 256])
def test_lists_without_a_similar_centre(spark, monkeypatch, short):
    """Passages that many share, in lists whose first and centre are like none of the pairs that meet there only."""
    monkeypatch.setattr(similar, "SHORT", short)
    monkeypatch.setattr(similar, "FREQUENT", min(short, 64))
    dice = random.Random(8)
    word = lambda: f"w{dice.getrandbits(40):x}"
    texts = []
    for size in (12, 40, 160):
        passage = [word() for _ in range(size // 2)]
        hub = passage + [word() for _ in range(size // 2)]
        texts += [" ".join(passage + [word() for _ in range(size // 2)]) for _ in range(150)]  # 1/3 alike
        texts += [" ".join(hub)] + [" ".join(hub[:-1] + [word()]) for _ in range(60)]  # the heaviest component, so every list's centre
        for _ in range(40):
            own = passage + [word() for _ in range(size // 2)]
            texts += [" ".join(own), " ".join(own[: -max(1, size // 12)] + [word() for _ in range(max(1, size // 12))])]
    chain = [word() for _ in range(400)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 340, 5)]  # each like its neighbours only
    dice.shuffle(texts)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=1).collect()}
    assert got == plain.similar(dict(enumerate(texts)), words=1)


# ---- archives


def test_of_two_attempts_one_is_read(spark):
    folder = fresh(spark, "attempts")
    pages = warc.revisits(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").repartition(2, "page_id"))
    lost = warc.write_archives(pages.orderBy(F.desc("page_id")).coalesce(2), folder).collect()  # other contents, and never reported
    kept = warc.write_archives(pages, folder).cache()
    got = sorted(r.page_id for r in warc.read_archives(kept, folder).collect())
    assert lost and not {r.path for r in lost} & {r.path for r in kept.collect()}
    assert got == sorted(r.page_id for r in pages.select("page_id").collect())


# ---- language model


def test_hmm_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "substring(text, 1, 300) AS text", "doc_id % 5 = 0 AS held_out").where("doc_id < 40")
    docs = docs.unionAll(spark.createDataFrame([(100, None, False), (101, "", True)], docs.schema))
    rows = docs.orderBy("doc_id").collect()
    begin = lambda f: (m := hmm.Hmm.begin(3, np.array(f, dtype=float))) and (m.start, m.move, m.emit)
    want = plain.hmm_scores([r.text for r in rows], [r.held_out for r in rows], begin, 3, 40, hmm.SHARED, hmm.shared_class, hmm.ADD, 3)
    for head in (60, 100_000):  # most words joined, and none
        got = {r.doc_id: r.score for r in hmm.score(docs, states=3, own=40, head=head, rounds=3).collect()}
        assert [got[r.doc_id] for r in rows] == pytest.approx(want, rel=1e-9)


def test_hmm_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 10 = 0 AS held_out")
    a, b = ({r.doc_id: r.score for r in hmm.score(docs.repartition(n)).collect()} for n in (4, 16))
    assert all(a[d] == pytest.approx(b[d], rel=1e-9) for d in a)


# ---- reading


def test_only_small_tables_are_dealt(spark):
    few, many = fresh(spark, "few"), fresh(spark, "many")
    spark.range(100).coalesce(1).write.parquet(few)
    spark.range(100).repartition(16).write.parquet(many)
    plan = lambda p: spread(spark.read.parquet(p))._jdf.queryExecution().toString()
    assert "Exchange" in plan(few) and "Exchange" not in plan(many)


def test_bitmaps_never_drop_a_similar_pair():
    dice = np.random.default_rng(6)
    sets, pairs, wanted, dropped = [], [], [], 0
    for _ in range(1500):
        n = int(dice.integers(1, dice.choice([8, 70, 300, 3000])))
        a = np.unique(dice.integers(0, 1 << 64, n, dtype=np.uint64))
        gone = int(dice.integers(0, n // 3 + 1))
        b = np.unique(np.concatenate([dice.permutation(a)[gone:], dice.integers(0, 1 << 64, int(dice.integers(0, gone + 1)), dtype=np.uint64)]))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        pairs.append((len(sets), len(sets) + 1))
        wanted.append(common >= 0.8 * (len(a) + len(b) - common))
        sets += [a, b]
    i, j = np.array(pairs).T
    kept = similar.distances(np.array([len(x) for x in sets]), similar.laid([similar.bitmap(x) for x in sets]), i, j, 0.8) < np.inf
    wanted = np.array(wanted)
    assert kept[wanted].all() and (~kept[~wanted]).mean() > 0.5


def test_second_index_tells_apart_what_is_just_below_the_similarity(spark):
    """40 documents of a template whose shingles are 0.74 alike: few of their 780 pairs are left to be compared exactly, and a pair that is similar is among them."""
    shared = [f"t{i}" for i in range(90)]
    texts = {k: " ".join([*shared, *(f"w{k}x{i}" for i in range(15))]) for k in range(40)}
    texts[40] = texts[7] + " more"
    held = spark.createDataFrame(list(texts.items()), "node long, text string")
    rest = held.select("node", F.col("node").alias("root"))
    found = {tuple(r) for r in similar.crossing(rest, held, np.zeros(0, dtype=np.uint64), 5, 0.8).collect()}
    assert (7, 40) in found and len(found) < 400
