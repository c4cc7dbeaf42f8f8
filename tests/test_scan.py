"""Scans by blocks give what a pass along the whole text gives, at every border."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import scan

TEXTS = [(1, "one\ntwo\n\nthree ü\n"), (2, ""), (3, None), (4, "\n" * 9), (5, "x"), (6, "\n".join(f"line {i}" for i in range(50)))]


@pytest.mark.parametrize("size", [1, 2, 3, 16_384])
def test_lines_and_their_neighbours(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "LINES", size)
    got = sorted(tuple(r) for r in scan.lines_in_context(spark.createDataFrame(TEXTS, "k int, text string"), "k", 2, 3).collect())
    want = []
    for k, t in TEXTS:
        lines, begin = (t.split("\n") if t is not None else []), 0
        for i, x in enumerate(lines):
            at = lambda j: lines[j] if 0 <= j < len(lines) else None  # noqa: E731, B023
            n = len(x) + (i + 1 < len(lines))
            want.append((k, i + 1, begin, n, i + 1 == len(lines), x, at(i - 1), at(i - 2), at(i + 1), at(i + 2), at(i + 3)))
            begin += n
    assert got == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("block", [1, 4, 7, 65_536])
@pytest.mark.parametrize("least", [1, 5])
def test_runs_across_borders(spark, block, least):
    dice, rows, want = random.Random(block), [], []
    for k, density in ((1, 0.5), (2, 0.9), (3, 1.0), (4, 0.1)):
        places = [i for i in range(200) if dice.random() < density]
        rows += [(k, i) for i in places]
        for i in places:
            if want and want[-1][0] == k and want[-1][1] + want[-1][2] == i:
                want[-1][2] += 1
            else:
                want.append([k, i, 1])
    dice.shuffle(rows)
    got = sorted([r.k, r.begin, r.length] for r in scan.runs(spark.createDataFrame(rows, "k int, pos long"), "k", least, block).collect())
    assert got == [r for r in want if r[2] >= least]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_sums_before(spark, block):
    rows = [(k, p, (p * 7 + k) % 5) for k in (1, 2) for p in range(0, 60, k)]
    got = {(r.k, r.pos): r.before for r in scan.sums_before(spark.createDataFrame(rows, "k int, pos int, n int"), "k", "pos", F.col("n"), "before", block).collect()}
    assert got == {(k, p): sum(n for a, b, n in rows if a == k and b < p) for k, p, _ in rows}


def test_no_text_is_shuffled(spark):
    plan = scan.lines_in_context(spark.createDataFrame(TEXTS, "k int, text string"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
