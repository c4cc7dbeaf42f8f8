"""Words inside words, by automaton and by join."""

import random

import pytest

from textloom.operators import containment


@pytest.mark.parametrize("most", [200_000, 0])
def test_words_inside_words(spark, monkeypatch, most):
    monkeypatch.setattr(containment, "MOST_WORDS", most)
    dice = random.Random(1)
    word = lambda n: "".join(dice.choice("abü") for _ in range(n))
    wanted = [word(dice.randint(2, 7)) for _ in range(80)] + ["", None, "zzz"]
    known = [word(dice.randint(1, 9)) for _ in range(60)] + ["", None, "zz"]
    got = {r.word for r in containment.contained(spark.createDataFrame([(w,) for w in wanted], "word string"), spark.createDataFrame([(w,) for w in known], "word string")).collect()}
    assert got == {w for w in wanted if w and any(w in k for k in known if k)} and got


def test_nothing_wanted(spark):
    none = spark.createDataFrame([], "word string")
    assert containment.contained(none, spark.createDataFrame([("a",)], "word string")).count() == 0
    assert containment.contained(spark.createDataFrame([("a",)], "word string"), none).count() == 0
