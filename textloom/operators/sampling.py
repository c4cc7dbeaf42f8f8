"""Writing with a count-based model: what may follow a context, and a sampler over prompts.

The model is a table of contexts and the characters behind them. Distributions are cut as tables (top-k keeps ties, top-p keeps what begins
below p). Dice are the first digits of an md5, which any engine can throw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ngrams import counted
from .scoring import END, Table, draw, write

__all__ = ["cut", "draw", "followers", "reply", "sample"]


def followers(training: DataFrame, order: int) -> DataFrame:
    """ctx, ch, n: how often each character, or END, follows the order - 1 characters before it."""
    counts = counted(training, order, end=END)
    return counts.select(F.expr(f"left(piece, {order - 1})").alias("ctx"), F.expr("right(piece, 1)").alias("ch"), "n")


def cut(model: DataFrame, top_k: int | None = None, top_p: float | None = None, mask_end: bool = False) -> DataFrame:
    """The model without what may not be drawn."""
    if (top_p is not None and not 0 < top_p <= 1) or (top_k is not None and top_k < 1):
        raise ValueError("top_p must be in (0, 1], top_k at least 1")
    w = Window.partitionBy("ctx")
    model = model.where(F.col("ch") != END) if mask_end else model
    if top_k is not None:
        model = model.withColumn("r", F.rank().over(w.orderBy(F.desc("n")))).where(F.col("r") <= top_k).drop("r")
    if top_p is not None:
        before = F.sum("n").over(w.orderBy(F.desc("n"), "ch")) - F.col("n")
        model = model.withColumns({"before": before, "total": F.sum("n").over(w)}).where(F.col("before") < F.col("total") * top_p).drop("before", "total")
    return model


def sample(prompts: DataFrame, model: DataFrame, key: str, order: int, characters: int, temperature: float = 1, seed: int = 0, stop: str | None = None, most: int = 2_000_000) -> DataFrame:
    """key, continuation, why: prompts (key, text) continued by a table of any size; up to `most` rows of it are sent to the tasks."""
    return write(prompts, Table(model, order - 1, most), key, characters, temperature, seed, stop)


def reply(said: DataFrame) -> DataFrame:
    """A continuation as a speech: cut back to a whole line where it ran to the end of its characters, without line breaks around it."""
    capped = F.col("why").startswith("wrote") & F.contains("continuation", F.lit("\n"))
    whole = F.when(capped, F.regexp_replace("continuation", r"(?s)\n[^\n]*$", "")).otherwise(F.col("continuation"))
    return said.withColumns({"reply": F.trim(whole, F.lit("\n")), "was_cut": capped})
