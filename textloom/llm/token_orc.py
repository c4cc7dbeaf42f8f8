"""Token ids in ORC files.

Documents are dealt by ranges of doc_id and sorted, so that files, stripes and row groups follow doc_id: stripe and row-index
statistics then prune by range, and a Bloom filter on doc_id prunes point lookups. Ids are an integer list column, which ORC
stores with run-length encoding (bit-packed). Stripes are read in parallel.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, share_code, table
from .tokens import encoder, in_parts

FILE_SCHEMA = "doc_id long, token_ids array<int>"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, stripe_bytes: int = 16 << 20, row_group: int = 10_000) -> None:
    """Write (doc_id, token_ids) in ascending order of doc_id, nulls first, then of the ids' crc32 and number. Null text counts as empty; an empty table gives an empty folder of files."""
    spark = docs.sparkSession
    share_code(spark)
    end = b"" if end_id is None else array("I", [end_id]).tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for begin, stop in in_parts(texts):
                data = [x + end for x in enc.encode([t or "" for t in texts[begin:stop]])]
                offsets = np.zeros(len(data) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in data], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(data))])
                crc = pa.array([zlib.crc32(x) for x in data], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(begin, stop - begin), pa.ListArray.from_arrays(pa.array(offsets), values), crc], names=["doc_id", "token_ids", "crc"])

    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text"))  # the text's hash as well, since one doc_id may stand in very many rows
    coded = dealt.mapInArrow(run, f"{FILE_SCHEMA}, crc long").sortWithinPartitions("doc_id", "crc", F.size("token_ids"))
    (
        coded.select("doc_id", "token_ids")
        .write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_group)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, token_ids. Filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_tokens, the crc32 of its ids as little-endian unsigned 32-bit integers, and the file it stands in."""
    share_code(stored.sparkSession)

    def run(batches):
        for b in batches:
            lists = b.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4").view("u1"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), b.column(2)], names=["doc_id", "n_tokens", "ids_crc32", "file"])

    return stored.select("doc_id", "token_ids", F.col("_metadata.file_name").alias("file")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file string")


def with_starts(digests: DataFrame) -> DataFrame:
    """Adds start: the sum of n_tokens of all rows before, in the order of the files.

    In a file rows follow doc_id (nulls first), crc32 and length. Files follow doc_id in the order of their numbers, so each is summed apart, and only totals, one per file, meet in one place. Files that
    do not follow each other are an error.
    """
    spark = digests.sparkSession
    rows = materialise(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    none = F.col("doc_id").isNull()
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(F.struct(~none, "doc_id")).alias("first"), F.max(F.struct(~none, "doc_id")).alias("last")).collect()
    key = lambda x: (x[0], x[1] or 0)
    before, parts, last = 0, [], (False, 0)
    for f in sorted(files, key=lambda f: int(re.search(r"part-(\d+)", f.file)[1])):
        if key(f.first) < last:
            raise ValueError(f"{f.file} begins before the end of the file before it")
        parts.append((f.file, before))
        before, last = before + f.n, key(f.last)
    if not parts:
        return digests.select("doc_id", F.lit(0).cast("long").alias("start"), "n_tokens", "ids_crc32")
    w = Window.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    offsets = F.broadcast(spark.createDataFrame(parts, "file string, before long"))  # one row per file
    return rows.withColumn("within", within).join(offsets, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh(spark, "token-orc")
    write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), path)
    return with_starts(token_digests(read_tokens(spark, path)))
