"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Among all rates r of its documents that meet the target, 0 <= r <= most, entropy balancing
takes those nearest to one copy of each: the least sum of r log r - r + 1. They are tilted exponentially, r = min(most, exp(l x)),
where x is the document's size over the source's mean size and l the multiplier of the source's word constraint. The dual is
convex, with gradient sum(size r) - target and curvature sum(size x r) over the rates below the bound. Newton steps for all
sources at once are aggregations over the histogram of sizes, kept inside a bracket that always holds the solution: with the
smallest x, log(target / words) / x is on the far side of it, and 0 on the near side.

Rates depend on source and size alone, so documents are rounded by cells of equal source and size. Cells go from large documents to
small ones, and what rounding gained or lost goes along, so that in the end the small ones make up for the large. In a
cell the documents' hashes say which of them get the one copy more. Hot cells are ranked in buckets of their hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, share_code, table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table with a row per source or cell that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: Documents of a cell in one bucket on average, and buckets of a cell at most.
BUCKET, MOST_BUCKETS = 512, 8192
#: Newton steps at most, and the share of a target that may be missing when they end.
STEPS, NEAR = 100, 1e-10


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _ranked(sources: DataFrame) -> DataFrame:
    """Rows with their rank from 0 by source, null last. Ranges are numbered apart; only their counts meet."""
    dealt = materialise(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = dealt.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("own", own).join(F.broadcast(offsets), "part").withColumn("rank", (F.col("own") + F.col("c0")).cast("long")).drop("part", "own", "c0")


def targets(sources: DataFrame, cycle: tuple[int, ...], most: int) -> DataFrame:
    """rank, source, source_size, target of each source (source, source_size): weights by rank, stopped at `most` times its size.

    The level is what a weight of one receives; whenever it takes sources over their bound, the others share what these leave.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    ranked = materialise(_ranked(sources).withColumn("weight", weight), "weights")
    bound = F.lit(float(most)) * F.col("source_size")
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (total or 0) / (weights or 1), 0
    while True:
        over = F.col("weight") * F.lit(level) >= bound
        n, held, free = ranked.agg(F.count_if(over), F.sum(F.when(over, bound)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped or not free:
            break
        level, stopped = (total - (held or 0.0)) / free, n
    return ranked.select("rank", "source", "source_size", F.least(F.col("weight") * F.lit(level), bound).alias("target"))


def solve(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """rank, tilt, mean: of each source (rank, source_size, target) the multiplier that makes its cells (rank, size, n) meet the target."""
    real = cells.where("size > 0")
    shape = real.groupBy("rank").agg(F.min("size").alias("least"), F.sum("n").alias("docs"))
    ratio = F.log(F.col("target") / F.col("source_size"))
    start = sources.where("source_size > 0 and target > 0").join(shape, "rank").withColumn("mean", F.col("source_size") / F.col("docs"))
    start = start.withColumn("far", ratio * F.col("mean") / F.col("least"))
    state = materialise(start.select("rank", "target", "mean", ratio.alias("tilt"), F.least("far", F.lit(0.0)).alias("low"), F.greatest("far", F.lit(0.0)).alias("high")), "tilt")
    rows = state.count()
    for _ in range(STEPS):
        now = real.join(_maybe_broadcast(state.select("rank", "tilt", "mean"), rows), "rank")
        exponent = F.col("tilt") * F.col("size") / F.col("mean")
        words, free = F.col("n") * F.col("size") * F.least(F.lit(float(most)), F.exp(F.least(exponent, F.lit(50.0)))), exponent < math.log(most)
        sums = now.groupBy("rank").agg(F.sum(words).alias("taken"), F.sum(F.when(free, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        gone = sums.join(_maybe_broadcast(state, rows), "rank").withColumn("off", F.col("taken") - F.col("target"))
        low, high = F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low")), F.when(F.col("off") >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide("off", "slope")
        done = F.abs("off") <= NEAR * F.col("target")
        tilt = F.when(done, F.col("tilt")).when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        state = materialise(gone.select("rank", "target", "mean", tilt.alias("tilt"), low.alias("low"), high.alias("high"), done.alias("done")), "tilt")
        if not state.where("not done").limit(1).count():
            break
        state = state.drop("done")
    return state.select("rank", "tilt", "mean")


def rounded(cells: DataFrame, most: int) -> DataFrame:
    """rank, size, n, copies: the copies of each cell (rank, size, n, rate) together, from large documents to small ones.

    A source's cells stream through one task, which holds one number; there are no more of them than words in its longest text.
    """
    share_code(cells.sparkSession)

    def run(batches):
        source, carried = None, 0.0
        for b in batches:
            ranks, sizes, counts, rates = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = np.zeros(len(ranks), dtype=np.int64)
            for i, (rank, size, n, rate) in enumerate(zip(ranks.tolist(), sizes.tolist(), counts.tolist(), rates.tolist())):
                if rank != source:
                    source, carried = rank, 0.0
                out[i] = n if not size else min(most * n, max(0, math.floor(n * rate + carried / size + 0.5)))
                carried += (n * rate - int(out[i])) * size
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out)], names=["rank", "size", "n", "copies"])

    dealt = cells.select("rank", "size", "n", "rate").repartition("rank").sortWithinPartitions("rank", F.desc("size"))
    return dealt.mapInArrow(run, "rank long, size long, n long, copies long")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies (0 to `most`), taken (words of all its copies).

    docs: doc_id, text, source. Sources are ranked by code point, null last, and weigh as `cycle` says, over and over; an empty
    name is a source of its own. Null and empty texts have size 0: they are taken as nothing, whatever their copies. Repeated rows are documents
    of their own; of equal rows any may get the copy that others lack. Sources without words have target 0. Ties in size go by the hash of
    id and text, so partitioning changes nothing. An empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = materialise(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("mark")), "sizes")
    counted = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    aims = materialise(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cycle, most), "targets")
    n_sources = aims.count()
    by_source = lambda df: df.alias("d").join(_maybe_broadcast(aims, n_sources).alias("a"), F.expr("d.source <=> a.source"))
    cells = materialise(by_source(counted).select("rank", "size", "n"), "ranked-cells")
    tilts = solve(cells, aims, most)
    rate = F.coalesce(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))), F.lit(1.0))
    copied = materialise(rounded(cells.join(_maybe_broadcast(tilts, n_sources), "rank", "left").withColumn("rate", rate), most), "copies")
    buckets = F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("n") / BUCKET)).cast("long")
    shares = copied.select("rank", "size", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("more"), buckets.alias("buckets"))
    placed = by_source(sized).select("doc_id", "d.source", "size", "mark", "rank", "source_size", "target")
    placed = placed.join(_maybe_broadcast(shares, copied.count()), ["rank", "size"]).withColumn("bucket", F.pmod("mark", "buckets"))
    cell = ["rank", "size", "bucket"]
    before = Window.partitionBy("rank", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # of one cell MOST_BUCKETS rows
    held = placed.where("buckets > 1 and more > 0").groupBy(*cell).agg(F.count("*").alias("c"))
    held = materialise(held.select(*cell, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before")), "buckets")
    placed = placed.join(_maybe_broadcast(held, held.count()), cell, "left")
    own = F.row_number().over(Window.partitionBy(*cell).orderBy("mark", "doc_id"))
    copies = F.col("each") + (F.coalesce("before", F.lit(0)) + own <= F.col("more")).cast("long")
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
