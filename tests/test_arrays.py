"""Arrays and lines under a checksum: round trips, what filters leave unread, jobs that fail."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.sources import arrays


@pytest.fixture(autouse=True)
def known(spark):
    arrays.register(spark)


def numbers(spark, n=5000, names=("a/b ü", "c"), kind="double"):
    return spark.range(n).select(F.explode(F.array(*map(F.lit, names))).alias("name"), F.col("id").alias("pos"), (F.col("id") * 0.5).cast(kind).alias("value"))


@pytest.mark.parametrize("kind", ["double", "float", "long", "int", "boolean"])
def test_round_trip(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(arrays, "PIECE", 1000)
    df = numbers(spark, kind=kind)
    df.repartitionByRange(3, "name", "pos").sortWithinPartitions("name", "pos").write.format("arrays").mode("append").save(f"file:{tmp_path}/t")
    back = spark.read.format("arrays").load(f"file:{tmp_path}/t")
    assert dict(back.dtypes)["value"] == dict(df.dtypes)["value"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_filters_leave_files_unread(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    numbers(spark).coalesce(1).sortWithinPartitions("name", "pos").write.format("arrays").mode("append").save(path)
    reader = arrays.ArraysReader(path, arrays.Arrays({"path": path})._parts())
    left = list(reader.pushFilters([arrays.GreaterThanOrEqual(("pos",), 10), arrays.LessThan(("pos",), 14), arrays.EqualTo(("name",), "c"), arrays.EqualTo(("value",), 6.0)]))
    assert [(p.name, p.first, p.count) for p in reader.partitions()] == [("c", 10, 4)] and len(left) == 1
    found = spark.read.format("arrays").load(path).where("pos >= 10 AND pos < 14 AND name = 'c' AND value > 5.0")
    assert sorted((r.pos, r.value) for r in found.collect()) == [(11, 5.5), (12, 6.0), (13, 6.5)]
    assert spark.read.format("arrays").load(path).where("name = 'none'").count() == 0


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    numbers(spark, 10).coalesce(1).write.format("arrays").mode("append").save(path)
    bad = numbers(spark, 4000).withColumn("value", F.when(F.col("pos") == 3999, F.raise_error(F.lit("no such luck")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no such luck"):
        bad.repartition(3).write.format("arrays").mode("append").save(path)
    assert [p.name[:5] for p in (tmp_path / "t").iterdir()] == ["part-"]
    assert spark.read.format("arrays").load(path).count() == 20
    numbers(spark, 3, ["new"]).coalesce(1).write.format("arrays").mode("overwrite").save(path)
    assert {r.name for r in spark.read.format("arrays").load(path).collect()} == {"new"}


def test_files_of_lost_attempts_do_not_count(tmp_path):
    import pyarrow as pa

    writer = arrays.ArraysWriter(str(tmp_path), False)
    rows = lambda v: iter([pa.RecordBatch.from_arrays([pa.array(["x"] * 3), pa.array(np.arange(3)), pa.array([v] * 3)], names=["name", "pos", "value"])])
    writer.write(rows(1.0))  # lost
    writer.commit([writer.write(rows(2.0)), None])
    reader = arrays.ArraysReader(str(tmp_path), arrays.Arrays({"path": str(tmp_path)})._parts())
    assert [v for p in reader.partitions() for b in reader.read(p) for v in b.column(2).to_pylist()] == [2.0] * 3
    with pytest.raises(ValueError, match="nulls"):
        writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([0]), pa.array([None], pa.float64())], names=["name", "pos", "value"])]))


def test_lines_under_a_checksum(spark, tmp_path, monkeypatch):
    texts = {"a.txt": "eins\nzwei ü\n\n", "b.txt": "drei", "empty.txt": "", "long.txt": "x" * 3_000_000 + "\nend\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    manifest = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}
    read = lambda m: spark.read.format("verified_lines").option("manifest", m).load(f"file:{tmp_path}")
    want = sorted((n, i, x) for n, t in texts.items() if t for i, x in enumerate(t.removesuffix("\n").split("\n"), 1))
    assert sorted(map(tuple, read(json.dumps(manifest)).collect())) == want
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert read(f"file:{tmp_path}/m.json").count() == len(want)
    (tmp_path / "a.txt").write_text("eins\nzwei u\n\n")  # one byte less
    with pytest.raises(Exception, match="a.txt is not what was recorded"):
        read(json.dumps(manifest)).count()
    with pytest.raises(Exception, match="c.txt is missing"):
        read(json.dumps({"c.txt": ""})).count()
