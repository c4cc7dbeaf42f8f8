"""Scans along long texts, by blocks: each block is summed up where it is, summaries meet, and blocks are finished by themselves.

A text's lines are given with their places and their neighbours by one pass over the text, so no rule on lines needs a shuffle. Runs of positions
and sums along pieces work by blocks of positions: a task has a block, not a text, and of a block only what crosses its borders, or its total,
meets with the others of its text.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a batch, and positions of a block.
LINES, BLOCK = 16_384, 65_536


def lines_in_context(texts: DataFrame, key: str, above: int = 3, below: int = 2) -> DataFrame:
    """key, line_no (from 1), begin, size, is_last, text, up1 .. and down1 ..: each line of a text (key, text) with its neighbours, null beyond the ends.

    begin counts the characters before the line; size has its line feed, if it isn't the text's last. Texts stay where they are; one of any length goes by
    in batches. Null texts have no lines, an empty one has one.
    """
    kind = texts.schema[key].dataType.simpleString()
    near = [f"up{i}" for i in range(1, above + 1)] + [f"down{i}" for i in range(1, below + 1)]

    def shifted(lines: pa.Array, at: int, n: int, by: int) -> pa.Array:
        """n lines from at + by on, with nulls where there are none."""
        begin, end = max(0, at + by), max(0, min(len(lines), at + by + n))
        before = pa.nulls(min(n, max(0, -(at + by))), pa.string())
        got = lines.slice(begin, max(0, end - begin))
        return pa.concat_arrays([before, got, pa.nulls(n - len(before) - len(got), pa.string())])

    def run(batches):
        for b in batches:
            for row in range(len(b)):
                text = b.column(1).slice(row, 1)
                if text.null_count:
                    continue
                lines = pc.split_pattern(text, "\n").flatten()
                sizes = pc.add(pc.utf8_length(lines), 1).cast(pa.int64())
                begins = pc.subtract(pc.cumulative_sum(sizes), sizes)
                for at in range(0, len(lines), LINES):
                    n = min(LINES, len(lines) - at)
                    last = pa.array([False] * (n - 1) + [at + n == len(lines)])
                    size = pc.subtract(sizes.slice(at, n), last.cast(pa.int64()))
                    own = b.column(0).take(pa.array([row] * n))
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(range(at + 1, at + n + 1), pa.int64()), begins.slice(at, n), size, last, lines.slice(at, n), *(shifted(lines, at, n, -i) for i in range(1, above + 1)), *(shifted(lines, at, n, i) for i in range(1, below + 1))],
                        names=[key, "line_no", "begin", "size", "is_last", "text", *near],
                    )

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {kind}, line_no long, begin long, size long, is_last boolean, text string, " + ", ".join(f"{x} string" for x in near))


def runs(places: DataFrame, key: str, least: int = 1, block: int = BLOCK) -> DataFrame:
    """begin, length of the runs of consecutive positions (key, pos; no row twice) of at least so many.

    Runs are found by block. Those that touch a border, two a block at most, are then joined along their text.
    """
    at = F.floor(F.col("pos") / block)
    island = places.withColumn("block", at).withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(key, "block").orderBy("pos")))
    own = island.groupBy(key, "block", "island").agg(F.min("pos").cast("long").alias("begin"), F.count("*").alias("length"))
    end = F.col("begin") + F.col("length")
    touches = (F.col("begin") % block == 0) | (end % block == 0)
    w = Window.partitionBy(key).orderBy("begin")
    edge = own.where(touches).select(key, "begin", "length", (F.coalesce(F.lag(end).over(w), F.lit(-1)) != F.col("begin")).cast("long").alias("new"))
    joined = edge.withColumn("run", F.sum("new").over(w)).groupBy(key, "run").agg(F.min("begin").alias("begin"), F.sum("length").alias("length")).drop("run")
    return own.where(~touches).select(key, "begin", "length").unionAll(joined).where(F.col("length") >= least)


def sums_before(rows: DataFrame, key: str, pos: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds `name`: the sum of a value over a text's rows at smaller positions. Blocks are summed apart; a row a block meets along its text."""
    cut = rows.withColumn(f"{name}_block", F.floor(F.col(pos) / block)).withColumn(f"{name}_value", value.cast("long"))
    before = Window.partitionBy(key).orderBy(f"{name}_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, f"{name}_block").agg(F.sum(f"{name}_value").alias("total"))
    starts = totals.select(F.col(key).alias(f"{name}_key"), F.col(f"{name}_block").alias(f"{name}_at"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias(f"{name}_start")).where(F.col(f"{name}_at") > 0)
    within = Window.partitionBy(key, f"{name}_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn(name, F.coalesce(F.sum(f"{name}_value").over(within), F.lit(0)))
    met = own.join(starts, (F.col(key) == F.col(f"{name}_key")) & (F.col(f"{name}_block") == F.col(f"{name}_at")), "left")
    return met.withColumn(name, F.col(name) + F.coalesce(F.col(f"{name}_start"), F.lit(0))).select(*rows.columns, name)
