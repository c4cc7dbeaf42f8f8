"""Mixing, ranked search and hard negatives against plain versions, on rows that are hard on them."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import lexical, mixing, negatives, token_counts
from textloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- mixing


def plain_mix(rows, cycle=(1, 2, 3), most=3):
    """Of (doc_id, text, source) rows: by source its size and target, and by (source, size) the copies of all its documents together."""
    sizes = [(s, len(SPACE.findall(t or ""))) for _, t, s in rows]
    words = Counter()
    for s, n in sizes:
        words[s] += n
    ranked = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(ranked)}
    target, open_, left = {}, set(ranked), float(sum(words.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * words[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(most * words[s]) for s in over}
        left -= sum(most * words[s] for s in over)
        open_ -= over
    copies = {}
    for s in ranked:
        cells = Counter(n for x, n in sizes if x == s)
        docs = sum(c for n, c in cells.items() if n)
        rate = lambda n, tilt: min(most, math.exp(min(50, tilt * n * docs / words[s])))
        low, high = -700.0, 700.0
        for _ in range(200 if words[s] else 0):
            tilt = (low + high) / 2
            low, high = (tilt, high) if sum(c * n * rate(n, tilt) for n, c in cells.items()) < target[s] else (low, tilt)
        carried = 0.0
        for n in sorted(cells, reverse=True):
            want = cells[n] * rate(n, low) if n else cells[n]
            copies[s, n] = min(most * cells[n], max(0, math.floor(want + carried / n + 0.5))) if n else cells[n]
            carried += (want - copies[s, n]) * n
    return words, target, copies


def check_mix(rows, got):
    words, target, copies = plain_mix(rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(SPACE.findall(t or ""))) for i, t, s in rows)
    cells = defaultdict(list)
    for r in got:
        assert r.source_size == words[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        cells[r.source, r.size].append(r.copies)
    for cell, own in cells.items():
        assert sum(own) == copies[cell] and max(own) - min(own) <= 1, cell


MIXED = [(i, "w " * ((i * 7) % 40), f"s{i % 7}" if i % 11 else None) for i in range(700)]
LOPSIDED = [(i, "a b c", "huge") for i in range(300)] + [(i, "x", "small") for i in range(300, 304)] + [(400, "", "no words"), (401, None, "no words"), (402, "ü 日本", ""), (402, "ü 日本", ""), (None, "one", None)]


@pytest.mark.parametrize("rows", [MIXED, LOPSIDED, [(1, None, None)], [(1, "only one", "s")]])
def test_mix_as_plain(spark, rows):
    check_mix(rows, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_mix_of_hard_rows_in_any_partitioning(spark, monkeypatch):
    df = plain.nasty(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    first = mixing.mix(df).collect()
    check_mix(rows, first)
    monkeypatch.setattr(mixing, "BUCKET", 2)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    check_mix(rows, mixing.mix(df.repartition(7)).collect())


def test_hot_cells_are_ranked_in_buckets_and_reruns_agree(spark, monkeypatch):
    rows = [(i, "one two three", "a") for i in range(900)] + [(i, "four five", "b") for i in range(900, 2000)]
    monkeypatch.setattr(mixing, "BUCKET", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    check_mix(rows, got)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.mix(df.repartition(9, "text")).collect())


def test_sources_come_near_their_targets(spark):
    got = QUERIES["op11_mixing"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    assert got and all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2 + 1 for r in got)


# ---- ranked search


def plain_search(docs, items, k=50):
    terms = lambda t: [x.decode() for x in TERM.findall((t or "").encode().lower())]
    held = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = Counter()
    for item, ts in asked.items():
        found = []
        for doc, counts, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m)) for t in ts if t in counts)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out.update((item, r, None if none else doc, -minus) for r, (minus, none, doc) in enumerate(sorted(found)[:k], 1))
    return out


HARD_ITEMS = [(1, "same text again"), (2, None), (3, ""), (4, "w5 thé5, w6 THÉ6 of nothing else"), (5, "WORDS"), (5, "one"), (6, "x y"), (None, "two words and a row"), (7, "... !")]


@pytest.mark.parametrize("small", [False, True])
def test_search_of_hard_rows(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical, "MOST_TERMS", 4)  # items in groups
        monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    items = spark.createDataFrame(HARD_ITEMS, "item_id long, text string").selectExpr("*", "'clash' AS term", "'clash' AS row")
    got = lexical.search(plain.nasty(spark), items, first=1, growth=2).collect()
    assert Counter(tuple(r) for r in got) == plain_search([(r[0], r[1]) for r in plain.NASTY], HARD_ITEMS)


@pytest.mark.parametrize("k,first,growth", [(3, 1, 2), (5, 4, 4), (50, 2, 3)])
def test_items_without_proof_fall_through(spark, k, first, growth):
    dice = random.Random(k)
    words = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(dice.choice(words[: dice.choice([5, 20, 60])]) for _ in range(dice.randint(1, 30)))) for i in range(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(150)]  # a third are copies
    items = [(i, " ".join(dice.choice(words) for _ in range(dice.randint(1, 8)))) for i in range(12)]
    found, proved = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k, first, growth)
    assert Counter(tuple(r) for r in found.collect()) == plain_search(docs, items, k)
    assert sum(proved) == 12 and len(proved) > 1 and proved[0] < 12


# ---- hard negatives


def plain_mine(rows, every=50, positives=5, negatives=3):
    kept = sorted({(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = Counter()
    for i, label, a in kept:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in kept if j != i and len(b) == len(a))
        for minus, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(-s, n) for s, n, other in scored if other != label and -50 * minus <= -100 * s <= -95 * minus][:negatives]
            out.update((i, p, r, n, -minus, s) for r, (s, n) in enumerate(fit, 1))
    return out


def vectors(seed, n, dims):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(4, dims))
    x = (centres[dice.integers(4, size=n)] + dice.normal(size=(n, dims)) * 0.4).astype(np.float32) / dims
    return [(i, x[i].tolist(), int(dice.integers(3))) for i in range(n)]


def as_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS q", "'clash' AS anchor")


@pytest.mark.parametrize("seed,dims", [(1, 8), (2, 64), (3, 3)])
def test_negatives_as_plain(spark, monkeypatch, seed, dims):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "GROUP", 5 * dims)  # several groups
    rows = vectors(seed, 700, dims)
    rows += [(1000 + i, rows[7][1], 1) for i in range(300)] + [(50, rows[7][1], 0)]  # copies, and an id twice
    assert Counter(tuple(r) for r in negatives.mine(as_table(spark, rows).repartition(3)).collect()) == plain_mine(rows)


def test_negatives_of_hard_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.9, 1.0], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0], 2), (8, [], 2), (9, [0.5, 1.0], None)]
    rows += [(None, [0.9, 1.0], 2), (50, [0.0, 0.0], 1), (51, [0.0, 0.0], 2), (100, [-1.0, -1.0], 3), (101, [1.0, 1.0], 3), (150, [1.0], 2), (10, [0.6, 1.0], 1), (-50, [0.7, 1.0], 2)]
    got = Counter(tuple(r) for r in negatives.mine(as_table(spark, rows)).collect())
    assert got == plain_mine(rows) and got


def test_intervals_hold_the_score():
    dice = np.random.default_rng(4)
    a, x = dice.integers(-300, 300, size=(5, 16)), dice.integers(-300, 300, size=(40, 16))
    planes, seen = negatives.Planes(int(x.min()), int(x.max())), []
    exact = a @ x.T

    def keep(i, j, low, high):
        want = exact if i is None else exact[i, j]
        assert (low <= want).all() and (want <= high).all()
        seen.append(np.max(high - low))
        return high >= 20_000

    i, j, scores = negatives.survivors(a.astype(float), planes.cut(x), planes.moved, np.ones(exact.shape, dtype=bool), keep)
    assert (scores == exact[i, j]).all() and len(i) == (exact >= 20_000).sum() and seen == sorted(seen, reverse=True) and seen[-1] == 0


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_hard_negatives"])
def test_larger_tables_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert oracle.differs(QUERIES[name](spark, sf), oracle.duck(sf), ORACLE_SQL[name]) == ""


# ---- token counts behind an apostrophe


def test_letters_held_behind_an_apostrophe():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, dice = Tokenizer.from_file(path), random.Random(5)
    ends = ["", "a", "1", ".", "'", " ", "é", "<|endoftext|>", "’"]
    held = ["'" + c[:i] for c in ("s", "t", "re", "ve", "m", "ll", "d") for i in range(len(c) + 1)]
    texts = ["press 'r' to run", "the letter 'v'.", "type 'l', then", "x'r."] + [f"{a}{h}{e}{b}" for a in ("", "x", "!") for h in held for e in ends for b in ("", "s", "'")]
    texts += ["".join(dice.choice("''strevmld .1é") for _ in range(dice.randint(1, 14))) for _ in range(2000)]
    texts += ["a" * (token_counts.CHUNK - i) + h + e + " b" for h in held for e in ends for i in range(4)]  # a chunk's border at each byte
    assert token_counts.Transducer(path).counts(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
