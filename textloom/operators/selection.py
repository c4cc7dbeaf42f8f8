"""Comparing runs: groups of seeds, the pooled test, the choice, block bootstrap."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import t_point

BLOCK = 5000


def groups(runs: DataFrame, score: str = "best") -> DataFrame:
    """arm, parameters, seeds, mean, sd, repeat_range: repeats of a seed are averaged first, and range so far; sd is null for one seed. Runs without a score are left out."""
    seeds = runs.where(F.col(score).isNotNull()).groupBy("arm", "parameters", "seed").agg(F.avg(score).alias("best"), (F.max(score) - F.min(score)).alias("repeats"))
    return seeds.groupBy("arm", "parameters").agg(F.count("*").alias("seeds"), F.avg("best").alias("mean"), F.stddev_samp("best").alias("sd"), F.max("repeats").alias("repeat_range"))


def completeness(runs: DataFrame) -> DataFrame:
    """arm, seeds, unfinished, replaced, status: complete only if all arms have the same number of seeds, three at least, and no run is unfinished."""
    per = runs.groupBy("arm").agg(F.count_distinct(F.when(F.col("state") == "done", F.col("seed"))).alias("seeds"), F.bool_or(F.col("state").isin("interrupted", "to do")).alias("unfinished"), F.bool_or("diverged").alias("replaced"))
    whole = per.agg(((F.count_distinct("seeds") == 1) & (F.min("seeds") >= 3) & ~F.bool_or("unfinished")).alias("whole"))
    return per.crossJoin(F.broadcast(whole)).select("arm", "seeds", "unfinished", "replaced", F.when(F.col("whole"), "complete").otherwise("PARTIAL").alias("status"))  # one row


def complete(runs: DataFrame) -> DataFrame:
    """complete: whether a verdict may be given. One row."""
    return completeness(runs).agg(F.bool_and(F.col("status") == "complete").alias("complete"))


def pooled(grouped: DataFrame) -> DataFrame:
    """pooled_sd, df: one row."""
    return grouped.agg(F.sqrt(F.sum(F.col("sd") * F.col("sd") * (F.col("seeds") - 1)) / F.sum(F.col("seeds") - 1)).alias("pooled_sd"), F.sum(F.col("seeds") - 1).alias("df"))


def verdicts(grouped: DataFrame, may: DataFrame | None = None) -> DataFrame:
    """Each pair of arms: their difference, the least that tells, DIFFERENT or tie (PARTIAL if `may` says that a verdict can't be given yet). There are as many rows as pairs of arms."""
    a, b = grouped.alias("a"), grouped.alias("b")
    pairs = _allowed(a.join(b, F.col("a.arm") < F.col("b.arm")).crossJoin(F.broadcast(pooled(grouped))), may)
    least = t_point(F.col("df")) * F.col("pooled_sd") * F.sqrt(1 / F.col("a.seeds") + 1 / F.col("b.seeds"))
    gap = F.col("b.mean") - F.col("a.mean")
    return pairs.select(F.col("a.arm").alias("first"), F.col("b.arm").alias("second"), gap.alias("difference"), least.alias("threshold"), _if(may, F.when(F.abs(gap) > least, "DIFFERENT").otherwise("tie"), "PARTIAL").alias("verdict"))


def choice(grouped: DataFrame, may: DataFrame | None = None) -> DataFrame:
    """The smallest arm within reach of the best mean; null as long as a verdict can't be given."""
    best = grouped.agg(F.min("mean").alias("lowest"), F.min_by("seeds", "mean").alias("best_seeds"))
    reach = t_point(F.col("df")) * F.col("pooled_sd") * F.sqrt(1 / F.col("seeds") + 1 / F.col("best_seeds"))
    near = _allowed(grouped.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(pooled(grouped))), may).where(F.col("mean") - F.col("lowest") <= reach)
    return near.agg(F.min_by(_if(may, F.col("arm"), None), F.struct("parameters", "mean", "arm")).alias("chosen"))


def _allowed(df: DataFrame, may: DataFrame | None) -> DataFrame:
    return df if may is None else df.crossJoin(F.broadcast(may))  # one row


def _if(may: DataFrame | None, told: Column, otherwise) -> Column:
    return told if may is None else F.when(F.col("complete"), told).otherwise(F.lit(otherwise))


def reason(**tests: Column) -> Column:
    """The first test that a run fails, by name; null if it may be chosen."""
    out = None
    for name, failed in tests.items():
        text = F.lit(name.replace("_", " "))
        out = F.when(failed, text) if out is None else out.when(failed, text)
    return out


def block_of(pos: Column) -> Column:
    return F.floor(pos / BLOCK)


def dice(seed: int, resample: Column, doc: Column, slot: Column, sides: Column) -> Column:
    """A number below `sides` that any engine can throw: the first 8 hex digits of an md5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), resample, doc, slot))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % sides


#: Numbers that are drawn at once.
DRAWS = 1_000_000


def _picks(seed: int, doc: str | None, resamples: range, sides: int) -> np.ndarray:
    """By resample and slot a block's number, with the dice of dice()."""
    named = "" if doc is None else f"{doc}|"
    thrown = (int.from_bytes(md5(f"{seed}|{r}|{named}{slot}".encode()).digest()[:4], "big") for r in resamples for slot in range(sides))
    return np.fromiter(thrown, np.int64, len(resamples) * sides).reshape(len(resamples), sides) % sides


def bootstrap(blocks: DataFrame, resamples: int, seed: int = 0) -> DataFrame:
    """low, high: 95 % interval of a ratio of sums, blocks (doc_id, block, bits, chars) drawn with replacement inside each text.

    A task draws all resamples of its texts and gives one sum for each; a text of one block needs no dice. Drawing takes far longer than its
    rows are large, so texts are dealt over all cores by number: by size they would share a task or two.
    """
    ordered = F.array_sort(F.collect_list(F.struct("block", F.col("bits").cast("double").alias("bits"), F.col("chars").cast("double").alias("chars"))))
    texts = blocks.groupBy("doc_id").agg(ordered.alias("blocks")).select(F.col("doc_id").cast("string").alias("doc"), F.col("blocks.bits").alias("bits"), F.col("blocks.chars").alias("chars"))
    spark = blocks.sparkSession
    texts = texts.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc")

    def run(batches):
        sums = np.zeros((2, resamples))
        for b in batches:
            for doc, *own in zip(*(c.to_pylist() for c in b.columns)):
                own = np.array(own)
                sides = own.shape[1]
                for at in range(0, resamples, step := max(1, DRAWS // sides)):
                    some = range(at, min(at + step, resamples))
                    sums[:, some.start : some.stop] += own[:, _picks(seed, doc, some, sides)].sum(axis=2) if sides > 1 else own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums[0]), pa.array(sums[1])], names=["r", "bits", "chars"])

    ratios = texts.mapInArrow(run, "r long, bits double, chars double").groupBy("r").agg((F.sum("bits") / F.sum("chars")).alias("x"))
    return ratios.agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
