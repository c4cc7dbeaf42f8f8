"""Rehearsals: digests don't depend on order, a changed constant is told by name, a block that fails stops no other."""

from pyspark.sql import functions as F

from textloom.operators import rehearsal
from textloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def blocks(spark, factor=2):
    t = spark.range(1000).select("id", (F.col("id") * factor).alias("x"), (F.col("id") / 7).alias("y"), F.when(F.col("id") % 3 == 0, F.lit("a")).alias("s"), F.create_map(F.lit("k"), "id").alias("m"))
    return {"plain": lambda: t, "grouped": lambda: t.groupBy("s").agg(F.sum("y").alias("y")), "empty": lambda: t.where("id < 0")}


def test_order_and_partitioning_change_no_digest(spark, tmp_path):
    first = rehearsal.attempt(spark, blocks(spark), f"file:{tmp_path}/record")
    again = {k: (lambda f=f: f().repartition(7).orderBy(F.rand(3))) for k, f in blocks(spark).items()}
    second = rehearsal.attempt(spark, again, f"file:{tmp_path}/record", f"file:{tmp_path}/results")
    assert {r.name: r.verdict for r in rehearsal.compared(second, first).collect()} == {"plain": "same", "grouped": "same", "empty": "same"}
    assert spark.read.parquet(f"file:{tmp_path}/results/plain").count() == 1000
    assert rehearsal.read_record(spark, f"file:{tmp_path}/record").where("status = 'done' AND ended >= began").count() == 6


def test_a_changed_constant_is_told_by_name(spark, tmp_path):
    record = f"file:{tmp_path}/record"
    rehearsal.attempt(spark, blocks(spark), record)
    before = rehearsal.read_record(spark, record)
    now = rehearsal.attempt(spark, blocks(spark, factor=3) | {"more": lambda: spark.range(3)}, f"{record}-2")
    assert {r.name: r.verdict for r in rehearsal.compared(now, before).collect()} == {"plain": "changed: 1000 rows then, 1000 now", "grouped": "same", "empty": "same", "more": "new"}
    swapped = {"plain": lambda: blocks(spark)["plain"]().withColumn("s", F.when(F.col("id") % 3 == 1, F.lit("a")))}
    verdicts = {r.name: r.verdict for r in rehearsal.compared(rehearsal.attempt(spark, swapped, f"{record}-3"), before).collect()}
    assert verdicts["plain"].startswith("changed") and verdicts["grouped"] == "missing"


def test_a_block_that_fails_stops_no_other(spark, tmp_path):
    record, good = f"file:{tmp_path}/record", blocks(spark)
    run = {"planned badly": lambda: spark.range(1).select("nothing"), "dies": lambda: spark.range(9).select(F.raise_error(F.lit("no such luck")).alias("x")), **good}
    got = rehearsal.attempt(spark, run, record).collect()
    assert [(r.name, r.status) for r in got] == [("planned badly", "failed"), ("dies", "failed"), ("plain", "done"), ("grouped", "done"), ("empty", "done")]
    assert got[1].why and got[1].n_rows is None and rehearsal.read_record(spark, record).count() == 5
    verdicts = rehearsal.compared(rehearsal.attempt(spark, {"dies": run["dies"]}, f"{record}-2"), rehearsal.read_record(spark, record))
    assert {r.name: r.verdict[:6] for r in verdicts.collect()} == {"dies": "failed", "plain": "missin", "grouped": "missin", "empty": "missin"}


def test_queries_are_rehearsed(spark, tmp_path):
    some = {n: (lambda n=n: QUERIES[n](spark, SF)) for n in ("q_split_sizes", "q_alphabet", "q_corpus_stats")}
    first, second = (rehearsal.attempt(spark, some, f"file:{tmp_path}/record") for _ in range(2))
    assert {r.verdict for r in rehearsal.compared(second, first).collect()} == {"same"}
