"""Bounds that hold whatever the rows: memory of short documents, orders of repeated ids, keys under other splits, rates of rejection."""

import random
import re
import resource
from collections import defaultdict

import pyarrow.dataset as ds
import public_tokenizers
from pyspark.sql import functions as F

from textloom.llm import ann, langid, licenses, packing, token_orc
from textloom.llm.common import fresh

SF = "/root/testdata/sf0.1"


def test_very_many_short_documents_take_little_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    windows = packing.pack([1] * 200_000, 2048)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 150
    assert sorted(i for w in windows for i in w) == list(range(200_000)) and max(map(len, windows)) <= 2048 and len(windows) == 98


def test_bundles_leave_windows_near_equal():
    dice = random.Random(2)
    for least, most in ((1, 40), (1, 512), (30, 34)):
        sizes = [dice.randint(least, most) for _ in range(3000)]
        windows = [sum(sizes[i] for i in w) for w in packing.pack(sizes, 2048)]
        assert sum(windows) == sum(sizes) and max(windows) <= 2048 and len(windows) <= -(-sum(sizes) // 2048) + 1 and max(windows) - min(windows) <= 64


def test_starts_are_places_in_the_files_for_repeated_ids(spark):
    rows = [(i % 3, f"text {i * 7919 % 101} " * (i % 5)) for i in range(60)] + [(None, "none"), (None, "nothing at all")] + [(2, "same")] * 5
    path = fresh(spark, "orc")
    token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), public_tokenizers.path("word_bpe_49k.json"), path)
    places, at = defaultdict(list), 0
    for file in sorted(ds.dataset(path, format="orc").files):
        for r in ds.dataset(file, format="orc").to_table().to_pylist():
            places[r["doc_id"]].append((at, len(r["token_ids"])))
            at += len(r["token_ids"])
    got = defaultdict(list)
    for r in token_orc.with_starts(token_orc.token_digests(token_orc.read_tokens(spark, path))).collect():
        got[r.doc_id].append((r.start, r.n_tokens))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in places.items()}


def test_keys_stay_under_other_splits(spark):
    import corpus_pipeline

    def keys(splits, cost):
        spark.conf.set("spark.sql.files.minPartitionNum", splits)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        docs, key = corpus_pipeline._keyed(spark.read.parquet(f"{SF}/documents.parquet"))
        return docs.rdd.getNumPartitions(), {(r[0], r[1]) for r in docs.select("doc_id", key).collect()}

    try:
        (few, first), (many, second) = keys(2, "4m"), keys(31, "4k")
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert few < many and first == second and len({k for _, k in first}) == 10_000


def test_rejections_of_learned_languages_are_rare_and_of_others_the_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = langid.fit(docs)
    cuts = [cut for _, _, cut in models.usual.values()]
    assert all(5 < c < 60 for c in cuts) and len(set(cuts)) > 1  # from the rows, not a constant
    found = langid.identify(docs, models).where("lang_pred <> 'und'").agg(F.avg(F.col("rejected").cast("int")), F.count("*")).first()
    assert found[0] <= langid.REJECTED
    others = ["Szybki brązowy lis przeskakuje nad leniwym psem i ucieka, bo nie ma czasu", "Быстрая коричневая лиса прыгает через ленивую собаку", "asdkjh qwoeiru zxmcnb qpwoei lkjsdf qwpeoru zmxnc", "Gyors barna róka átugrik a lusta kutya fölött, mert nincs ideje"]
    assert all(r[3] for r in models.predict(others))


def test_conformal_quantiles_hold_their_rate():
    dice = random.Random(3)
    models = langid.Models({"xx": langid.np.unique(langid.grams(["abc abd acd"])[0], return_counts=True)})
    draw = lambda: ("xx", 1.5 + abs(dice.gauss(0, 1)) * 0.02, 400)
    models.calibrate([draw() for _ in range(4000)])
    mean, scale, cut = models.usual["xx"]
    beyond = sum(models.away(*draw()) > cut / langid.MARGIN for _ in range(20_000)) / 20_000
    assert beyond <= 3 * langid.REJECTED


def test_few_queries_are_compared_with_all_vectors(spark, monkeypatch):
    """With the query's own parameters: how many have no chance of success within reach, or find too few."""
    short, write = [], ann.materialise
    monkeypatch.setattr(ann, "materialise", lambda df, name: (short.append(df.count()) if name == "short-queries" else None) or write(df, name))
    found = ann.op5(spark, SF)
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert found.select("query_id").distinct().count() == asked and len(short) == 1 and short[0] <= 0.05 * asked


def sentence(pattern: str) -> str:
    """One that an expression of these rules matches: first alternatives, one word for any."""
    while "(" in pattern:
        pattern = re.sub(r"\((?:\?:|\?P<\w+>)([^()|]*)(?:\|[^()]*)?\)(?:\?|\{[^}]*\})?", r"\1", pattern.replace("[^ ]+", "x"))
    return pattern.replace("?", "")


def test_each_sentence_of_a_license_fires_and_holds_its_keyword():
    assert len(licenses.SIGNATURES) + len(licenses.BODIES) > 220
    fired = set()
    for label, pattern in licenses.BODIES:
        text = sentence(pattern)
        own = [(i, r) for i, r in enumerate(licenses.RULES) if r[4].pattern == rf"(?<![^ ])(?:{pattern})(?![^ ])" and r[1] == label]
        assert own and own[0][1][4].fullmatch(text), (pattern, text)
        assert own[0][1][3] in text and len(own[0][1][3]) >= 8, own[0][1][3]
        fired |= {x[0] for x in licenses.scan(f"before {text} after".encode())[2]}
    assert len(fired & {label for label, _ in licenses.BODIES}) > 0.9 * len({label for label, _ in licenses.BODIES})
