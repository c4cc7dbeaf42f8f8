"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

A document's ids fill whole windows first; what is left is cut into pieces of at most `piece` ids. Pieces gather in blocks
worth `windows` windows; the pieces of a block are divided over k windows by differencing: every piece starts as a partial
partition of its own (k subsets, one not empty), and the two partial partitions with the largest imbalance are merged, the
fullest subsets of one with the emptiest of the other, until one is left. k begins at the least that could hold the
block and rises while the fullest window exceeds the capacity.

No shuffle: each task packs the documents it reads. Its sequence numbers begin at its partition's own range, so a task that
runs again gives the same rows.
"""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import share_code, spread, table
from .tokens import encoder, in_parts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of `sizes` in k subsets of nearly equal sums; ties go to the earlier item."""
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [[i]] + [None] * (k - 1)))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]  # both run from fullest to emptiest: opposing imbalances meet
        order = np.argsort(-sums, kind="stable")
        both = [(x + y if x and y else x or y) for x, y in zip(in_a, reversed(in_b))]
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, [both[j] for j in order]))
        serial += 1
    return [x for x in heap[0][3] if x] if heap else []


def bundles(sizes: list[int], least: int) -> list[list[int]]:
    """Items of `least` or more alone, smaller ones in the order they come until together they are as large."""
    out, held, total = [], [], 0
    for i, n in enumerate(sizes):
        if n >= least:
            out.append([i])
            continue
        held.append(i)
        total += n
        if total >= least:
            out.append(held)
            held, total = [], 0
    return out + [held] * bool(held)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item indices, none over the capacity; their count rises until all fit.

    Items below a 64th of a window are bundled first, so that partial partitions number 64 a window, however short the items are.
    """
    if not sizes:
        return []
    items = bundles(sizes, max(1, capacity // 64))
    sums = [sum(sizes[i] for i in x) for x in items]
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sums, k)
        if max(sum(sums[j] for j in w) for w in windows) <= capacity:
            return [[i for j in w for i in items[j]] for w in windows]
        k += max(1, k // 200)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, piece: int = 512, windows: int = 96, end_id: int | None = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it begins in its document, its length and crc32, its sequence and the offset there.

    docs: doc_id, text. Null text counts as empty (one piece, the end id); a repeated row is a document of its own; an empty
    table gives no rows; without an end id a document of no ids gives no piece. with_ids adds the ids of each piece.
    """
    spark = docs.sparkSession
    share_code(spark)
    if not 0 < piece <= capacity:
        raise ValueError("a piece has at least one id and fits in a window")
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    end = b"" if end_id is None else array("I", [end_id]).tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        block: list[tuple] = []
        held = 0
        out: list[tuple] = []

        def flush():
            nonlocal sequence, block, held
            for w in pack([x[2] for x in block], capacity):
                offset = 0
                for i in w:
                    doc, start, n, crc, total, ids = block[i]
                    out.append((doc, start, n, crc, total, sequence, offset, ids))
                    offset += n
                sequence += 1
            block, held = [], 0

        def batch():
            columns = list(zip(*out)) if out else [[]] * 8
            out.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for begin, stop in in_parts(texts):
                for doc, data in zip(ids[begin:stop], enc.encode([t or "" for t in texts[begin:stop]])):
                    data += end
                    total, at = len(data) // 4, 0
                    while at < total:
                        n = capacity if total - at >= capacity else min(piece, total - at)
                        part = data[4 * at : 4 * (at + n)]
                        row = (doc, at, n, zlib.crc32(part), total)
                        if n == capacity:
                            out.append((*row, sequence, 0, part if with_ids else None))
                            sequence += 1
                        else:
                            block.append((*row, part if with_ids else None))
                            held += n
                            if held >= windows * capacity - piece:
                                flush()
                        at += n
                if len(out) >= 20_000:
                    yield batch()
        flush()
        yield batch()

    schema = SCHEMA + ", ids array<int>" * with_ids
    return spread(docs.select("doc_id", "text"), "doc_id", per_core=1).mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
