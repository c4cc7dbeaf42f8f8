"""Small files beside tables: run folders, tokenizers, logs. Through Hadoop's file system, so any store that Spark reads will do."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in spark.checkpoint.dir; where that is unset and all is one process, in a folder of our own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        folder = sc.getCheckpointDir()
    return f"{folder if '://' in folder or folder.startswith('file:') else 'file://' + os.path.abspath(folder)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the table to a new place and read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, pattern: str) -> bool:
    fs, where = _fs(spark, pattern)
    found = fs.globStatus(where)
    return found is not None and len(found) > 0


def put(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small text file; an error if it is there already, unless it may be replaced."""
    fs, where = _fs(spark, path)
    out = fs.create(where, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Put a file in another's place in one step: whoever looks sees the one or the other. Needs a store whose renames are atomic, as HDFS's and local ones are."""
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    source, target = jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(old)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, how)


#: Names the version of a table that counts.
POINTER = "CURRENT"


def swap_in(df: DataFrame, path: str) -> None:
    """Write a new version of a table into its folder, then let the pointer beside it name that one; versions before it go last.

    Whatever fails before the pointer swings changes nothing, and leaves at most a version that nobody reads until the next swap removes it.
    """
    spark, name = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    put(spark, made := f"{path}/.{POINTER}-{uuid.uuid4().hex}", name)
    replace(spark, made, f"{path}/{POINTER}")
    fs, where = _fs(spark, path)
    for x in fs.listStatus(where):
        if x.getPath().getName() not in (name, POINTER):
            fs.delete(x.getPath(), True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that was swapped in last."""
    fs, where = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(where):
        raise FileNotFoundError(f"nothing was swapped in at {path}")
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}")


def claim(spark: SparkSession, path: str, note: dict) -> None:
    """A one-way door: note that a job has begun. An error if any job ever has. Needs a store that creates files exclusively, as HDFS and local ones do."""
    put(spark, path, json.dumps(note))


def complete(spark: SparkSession, path: str, result: dict) -> None:
    """Replace a claim by its result, in one move; an error without a claim. A crash before it leaves the claim."""
    if not exists(spark, path):
        raise FileNotFoundError(f"nothing was claimed at {path}")
    put(spark, made := f"{path}.{uuid.uuid4().hex}", json.dumps(result))
    replace(spark, made, path)


def verified(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """file, text of a manifest's files (file, sha256), read whole. A file that is missing or is not what its checksum says is an error."""
    read = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.sha2("content", 256).alias("found"))
    both = manifest.select("file", "sha256").join(read, "file", "left")
    wrong = F.concat("file", F.lit(" is "), F.coalesce(F.concat(F.lit("not what was recorded: "), "found"), F.lit("missing")))
    return both.select("file", F.when(F.col("found").eqNullSafe(F.col("sha256")), F.decode("content", "UTF-8")).otherwise(F.raise_error(wrong)).alias("text"))


# ---- run folders

CONFIG = "name string, arm string, seed int, steps int, parameters long, git_commit string, sixteen_bit boolean, vocabulary int"
RESULT = "best struct<validation_bpc: double, step: long, passes: double, seen_bpc: double>, final_validation_bpc double, minutes double"
EVALUATION = "everything_else struct<bits_per_character: double>"


def write_runs(spark: SparkSession, folder: str, runs: list[dict]) -> None:
    """A folder per run: config.json, and what else there is of result.json, evaluation-best.json, log.csv, last.pt and DIVERGED."""
    for run in runs:
        for file, content in run.items():
            put(spark, f"{folder}/{run['config.json']['name']}/{file}", content if isinstance(content, str) else json.dumps(content, indent=1))


def _json(spark: SparkSession, folder: str, prefix: str, file: str, schema: str) -> DataFrame:
    """run (the folder's name) and the file's fields; no rows where no run has the file."""
    pattern = f"{folder}/{prefix}*/{file}"
    if not exists(spark, pattern):
        return spark.createDataFrame([], f"run string, {schema}")
    return spark.read.schema(schema).json(pattern, multiLine=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), "*")


def _there(spark: SparkSession, folder: str, prefix: str, file: str) -> DataFrame:
    """run, for runs that have the file, be it empty: from the listing, a name per run."""
    fs, pattern = _fs(spark, f"{folder}/{prefix}*/{file}")
    return spark.createDataFrame([(x.getPath().getParent().getName(),) for x in fs.globStatus(pattern) or []], "run string")


def read_runs(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """All runs whose name begins with the prefix: settings, scores (null without a file), and state: done, diverged, interrupted or to do."""
    out = _json(spark, folder, prefix, "config.json", CONFIG)
    out = out.join(_json(spark, folder, prefix, "result.json", RESULT).withColumn("finished", F.lit(True)), "run", "left")
    out = out.join(_json(spark, folder, prefix, "evaluation-best.json", EVALUATION).select("run", F.col("everything_else.bits_per_character").alias("everything_else")), "run", "left")
    for file, name in (("DIVERGED", "diverged"), ("last.pt", "begun")):
        out = out.join(_there(spark, folder, prefix, file).withColumn(name, F.lit(True)), "run", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(yes("finished"), "done").when(yes("diverged"), "diverged").when(yes("begun"), "interrupted").otherwise("to do")
    return out.select("run", "arm", "seed", "steps", "parameters", "git_commit", "sixteen_bit", "vocabulary", F.col("best.validation_bpc").alias("best"), F.col("best.step").alias("best_step"), "final_validation_bpc", "minutes", "everything_else", yes("diverged").alias("diverged"), state.alias("state"))


LOG = "step int, passes double, learning_rate double, training_loss double, validation_bpc double, tokens_per_second double"


def read_logs(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Rows of all runs' logs, with the run; `nan` is NaN, not null."""
    return spark.read.csv(f"{folder}/{prefix}*/log.csv", header=True, schema=LOG, nanValue="nan").select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), "*")
