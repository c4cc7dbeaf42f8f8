"""Rehearsals: results are known by a digest, runs are held against digests on record, and one that fails stops no other.

A digest says how many rows a result has and what the hashes of its rows add up to, so order and partitioning don't matter. It is taken while the
result is written, from the same pass. Each block of a run leaves a record when it ends, however it ends, with times in UTC.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of the record of a run.
RECORD = "name string, status string, why string, began timestamp, ended timestamp, n_rows long, digest string"
#: Decimal places that floating-point numbers are compared to.
PLACES = 6


def _steady(c: str, kind: str, places: int) -> Column:
    """A column as it is compared: floating-point numbers rounded (-0 as 0), maps as their sorted entries."""
    if kind in ("double", "float"):
        return F.round(F.col(f"`{c}`").cast("double"), places) + F.lit(0.0)
    if kind.startswith("map<"):
        return F.array_sort(F.map_entries(f"`{c}`"))
    return F.col(f"`{c}`")


def observed(df: DataFrame, places: int = PLACES) -> tuple[DataFrame, Observation]:
    """The same rows, and what their digest will be told by once they have been written."""
    seen = Observation(f"digest-{uuid.uuid4().hex}")
    columns = [_steady(c, kind, places) for c, kind in sorted(df.dtypes)]
    # two hashes of each row, summed without overflow; nulls are told apart from what hashes like them
    row = F.struct(*columns, *[c.isNull() for c in columns])
    sums = [F.sum(F.xxhash64(row, F.lit(salt)).cast("decimal(38,0)")).alias(f"sum{salt}") for salt in (1, 2)]
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *sums), seen


def digest(seen: Observation, columns: list[str]) -> tuple[int, str]:
    """How many rows there were, and their digest with the columns' names."""
    got = seen.get
    return got["n_rows"], f"{'|'.join(sorted(columns))}#{got['n_rows']}#{got['sum1'] or 0}#{got['sum2'] or 0}"


def attempt(spark: SparkSession, blocks: dict[str, Callable[[], DataFrame]], record: str, results: str | None = None) -> DataFrame:
    """Run blocks by name, each to the end or to its failure, and append what became of each to the record (JSON lines); gives this run's part of it.

    results: a folder where each block's rows are kept under its name; without one they are only counted and hashed.
    """
    rows = []
    for name, block in blocks.items():
        began = datetime.now(timezone.utc)
        try:
            df, seen = observed(block())
            out = df.write.mode("overwrite")
            out.parquet(f"{results}/{name}") if results else out.format("noop").save()
            n, found = digest(seen, df.columns)
            row = (name, "done", None, began, datetime.now(timezone.utc), n, found)
        except Exception as e:  # the other blocks have their own right to run
            row = (name, "failed", f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"[:500], began, datetime.now(timezone.utc), None, None)
        rows.append(row)
        # at once, so that a run that is killed leaves what it finished
        spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").json(record)
    return spark.createDataFrame(rows, RECORD)


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """name, verdict of each block of two records: same, changed (with both numbers of rows), failed, new, or missing from this run.

    Of a name with several rows on record the last that was done counts.
    """
    done = before.where("status = 'done'").groupBy("name").agg(F.max_by(F.struct("n_rows", "digest"), "ended").alias("old"))
    both = now.select("name", "status", "why", "n_rows", "digest").join(done, "name", "full")
    verdict = (
        F.when(F.col("status").isNull(), "missing").when(F.col("status") == "failed", F.concat(F.lit("failed: "), "why")).when(F.col("old").isNull(), "new")
        .when(F.col("digest") == F.col("old.digest"), "same").otherwise(F.concat(F.lit("changed: "), F.col("old.n_rows"), F.lit(" rows then, "), F.col("n_rows"), F.lit(" now")))
    )
    return both.select("name", verdict.alias("verdict"))


def read_record(spark: SparkSession, record: str) -> DataFrame:
    return spark.read.schema(RECORD).json(record)
