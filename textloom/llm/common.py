"""What the operators of this subpackage share: reading, spreading work, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The wanted columns of a table; others, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Deal a table of few partitions over the cores; leave one that has enough as it is, without a shuffle."""
    spark = df.sparkSession
    wanted = per_core * spark.sparkContext.defaultParallelism
    full = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    # as planned, without a job: each file is a split at least, and large ones are cut
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if len(df._jdf.inputFiles()) >= wanted or size >= wanted * full:
        return df
    return df.repartition(wanted, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, one of our own if driver and executors are one process (as in tests), else an error: a folder of one
    machine would hide what executors write from each other.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        folder = sc.getCheckpointDir()
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it again. folders: columns that get a folder for each value."""
    path = fresh(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows in what runs meanwhile, for rows that hold lists or pairs of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What makes workers give memory back to the system when an array goes.
FRUGAL = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_MMAP_THRESHOLD_": "1048576"}


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver has it on sys.path alone, and keep them small between batches."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    for name, value in FRUGAL.items():
        env.setdefault(name, os.environ.get(name, value))


def crc_bucket(column: str, n: int):
    """crc32 of a column's text modulo n: the deterministic split that the queries use."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
