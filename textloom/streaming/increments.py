"""Counts that follow a growing folder of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def arriving(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Documents of a folder's Parquet files, each file once, as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def chunk_counts(stream: DataFrame) -> DataFrame:
    """chunk, n over all that has come; the state is one row per distinct chunk."""
    return stream.select(F.explode(chunks("text")).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
