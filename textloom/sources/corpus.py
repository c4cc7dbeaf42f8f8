"""Where texts come from: documents with their split, transcripts, run records, and the sinks beside them."""

from __future__ import annotations

from datetime import datetime, timezone
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Asked for before the test set is given.
UNLOCK = "final evaluation"
SETS = ("train", "validation", "test")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table of few partitions over all cores, before its texts are taken apart; one that has enough stays as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # as planned, without a job: each file is a split at least, and large ones are cut
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    enough = len(df._jdf.inputFiles()) >= cores or size >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if enough else df.repartition(cores, *keys)


def split_of(doc_id: str = "doc_id"):
    """Whole documents: 0 of ten is validation, 1 of ten test, the rest train."""
    part = F.pmod(F.col(doc_id), F.lit(10))
    return F.when(part == 0, "validation").when(part == 1, "test").otherwise("train")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the set they belong to. Dealt by text, since a few files may hold all."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id").withColumn("set", split_of())


def load_set(spark: SparkSession, sf_dir: str, which: str, unlock: str = "", manifest: DataFrame | None = None) -> DataFrame:
    """One set, with each text's SHA-256. The test set stays locked without the phrase.

    With a manifest (doc_id, sha256) each text is held against what was recorded of it, in the scan that gives it: a job that reads a text
    that differs, or that nobody recorded, fails.
    """
    if which not in SETS:
        raise ValueError(f"no set {which}")
    if which == "test" and unlock != UNLOCK:
        raise PermissionError("the test set is locked")
    own = documents(spark, sf_dir).where(F.col("set") == which).withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    if manifest is None:
        return own
    told = manifest.select(F.col("doc_id").alias("told_id"), F.col("sha256").alias("told"))
    wrong = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without an id")), F.when(F.col("told").isNull(), " has no checksum on record").otherwise(" is not what was recorded"))
    checked = F.when(F.col("told").eqNullSafe(F.col("sha256")), F.col("text")).otherwise(F.raise_error(wrong))
    return own.join(told, F.col("doc_id") == F.col("told_id"), "left").select(*[checked.alias(c) if c == "text" else c for c in own.columns])


def lines(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no from 1, text): numbers never shift, whatever later rules drop."""
    return df.select(key, F.posexplode(F.split("text", "\n")).alias("at", "text")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "text")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations laid out as speech: a blank line, the speaker in capitals with a full stop, the words."""
    turns = dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id")
    speaker = F.rtrim(F.upper(F.trim("role")), F.lit("."))
    said = F.concat(F.lit("\n\n"), speaker, F.lit(".\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("said"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["said"]), "").alias("text"))


def append_attempt(df: DataFrame, path: str) -> None:
    """Audit rows, as JSON lines, each with the time (`at`, in UTC) unless it brings one; nothing already there is touched."""
    now = F.lit(datetime.now(timezone.utc).isoformat(timespec="seconds"))
    (df if "at" in df.columns else df.withColumn("at", now)).write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """A one-way door: fails if the place is taken."""
    df.write.mode("errorifexists").parquet(path)
