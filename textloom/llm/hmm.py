"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Words are observed as classes: the `own` most frequent words each have one, all others share 64 by a hash of their last
bytes, and the end of a text has one. A word of a shared class has the probability of its class in the state times its
smoothed share of that class, which no state changes; so the forward recursion runs over classes, and counts of
rare words meet their texts in one join.

Counts of all training words are gathered by word. Words above a count that at most `head` words reach are sent to the
workers; only the others are joined, and none of those is frequent. Baum-Welch takes `rounds` steps from a fixed start, each
over all training texts: tasks run the scaled forward and backward recursions and give expected counts, which are summed over
partitions by class. The last forward pass gives each text's likelihood. Nothing depends on how the table is partitioned, but
for the rounding of sums (1e-9 of a score in tests).
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, materialise, share_code, spread, table

SHARED = 64
#: Added to the counts of words, as in the base score.
ADD = 0.1
#: Cells (texts times places) of the arrays that recursions work on.
CELLS = 300_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shared_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SHARED


def in_blocks(sequences: list[np.ndarray]):
    """Sequences by falling length, in blocks: (places in the list, classes by time, how many are alive at each time)."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        some = order[at : at + max(1, CELLS // max(1, longest))]
        at += len(some)
        sizes = np.array([len(sequences[i]) for i in some])
        ids = np.zeros((longest, len(some)), dtype=np.int64)
        for j, i in enumerate(some):
            ids[: sizes[j], j] = sequences[i]
        yield some, ids, (sizes[None, :] > np.arange(longest)[:, None]).sum(axis=1)


class Hmm:
    """start (states), move (states x states), emit (classes x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, states: int, frequency: np.ndarray) -> Hmm:
        """Classes at their frequencies, each leaning to some of the states by dice of its place in the list.

        States nearly always stay, so that a whole text's evidence parts them: three or four steps settle what takes over ten from
        states that change freely.
        """
        dice = np.random.default_rng(7)
        emit = (frequency + 0.5)[:, None] * dice.exponential(1.0, (len(frequency), states))
        move = np.full((states, states), 1.0) + np.eye(states) * 1000
        return cls(np.full(states, 1.0 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def estimate(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        """From expected counts."""
        start, move, emit = start + 0.1, move + 0.1, emit + 0.01
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, ids: np.ndarray, alive: np.ndarray):
        seen = self.emit[ids]
        alpha, scale = np.zeros_like(seen), np.ones(ids.shape)
        now = self.start * seen[0]
        for t in range(len(ids)):
            n = alive[t]
            if t:
                now = (alpha[t - 1, :n] @ self.move) * seen[t, :n]
            total = now[:n].sum(axis=1)
            alpha[t, :n], scale[t, :n] = now[:n] / total[:, None], total
        return seen, alpha, scale

    def likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of each sequence's probability (0 of an empty one)."""
        out = np.zeros(len(sequences))
        for some, ids, alive in in_blocks(sequences):
            if len(ids):
                out[some] = np.log10(self.forward(ids, alive)[2]).sum(axis=0)
        return out

    def expect(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions."""
        states = len(self.start)
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros(self.emit.shape)
        for _, ids, alive in in_blocks([s for s in sequences if len(s)]):
            seen, alpha, scale = self.forward(ids, alive)
            beta = np.ones_like(alpha)
            for t in range(len(ids) - 2, -1, -1):
                n = alive[t + 1]
                ahead = seen[t + 1, :n] * beta[t + 1, :n] / scale[t + 1, :n, None]
                beta[t, :n] = ahead @ self.move.T
                move += alpha[t, :n].T @ ahead
            gamma = alpha * beta  # alpha is 0 where a text has ended
            start += gamma[0].sum(axis=0)
            flat = ids.ravel()
            for s in range(states):
                emit[:, s] += np.bincount(flat, weights=gamma[:, :, s].ravel(), minlength=len(emit))
        return start, move * self.move, emit


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype="<u2").astype(np.int64) for x in column]


def _bin(n: str) -> Column:
    """Counts up to 128 each alone, above that 64 steps an octave: some 3,700 bins, whatever the corpus."""
    octave = F.greatest(F.floor(F.log2(n)) - 6, F.lit(0))
    return octave * 1000 + F.floor(F.col(n) / F.pow(F.lit(2.0), octave))


def _thresholds(counts: DataFrame, *most: int) -> tuple[list[int], int, int]:
    """For each of `most` the least count from which on at most so many words are left; how many words there are, and their tokens."""
    bins = sorted((tuple(r) for r in counts.withColumn("bin", _bin("n")).groupBy("bin").agg(F.min("n"), F.count("*"), F.sum("n")).collect()), reverse=True)
    out = []
    for limit in most:
        held, least = 0, 1 << 62
        for _, low, k, _ in bins:
            held += k
            if held > limit:
                break
            least = low
        out.append(least)
    return out, sum(b[2] for b in bins), sum(b[3] for b in bins)


def score(docs: DataFrame, states: int = 4, own: int = 8192, head: int = 100_000, rounds: int = 4) -> DataFrame:
    """docs: doc_id, text, held_out. Per document: n_tokens, n_known, train_tokens, base_score and score.

    Learns from rows whose held_out is false. Null and empty texts are the end alone. Repeated rows are texts of their own.
    Without training rows every token has the base probability one, and the model is uniform over its classes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    share_code(spark)
    if own + SHARED + 1 > 1 << 16:
        raise ValueError("classes are 16-bit")
    docs = spread(docs.select("doc_id", "text", "held_out"), "doc_id", per_core=1)

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                held.update(words_of(t.as_py()))
                if len(held) > 400_000:
                    yield give(held)
                    held.clear()
        yield give(held)

    def give(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64()), pa.array([shared_class(w) for w in held], pa.int32())], names=["word", "n", "class"])

    training = docs.where(~F.col("held_out"))
    counts = materialise(training.select("text").mapInArrow(count, "word binary, n long, class int").groupBy("word", "class").agg(F.sum("n").alias("n")), "word-counts")
    texts = training.count()
    (own_from, head_from), kinds, total = _thresholds(counts, own, head)
    total, kinds = total + texts, kinds + (texts > 0)

    frequent = sorted(((bytes(r[0]), r[1], r[2]) for r in counts.where(F.col("n") >= head_from).select("word", "n", "class").collect()), key=lambda x: (-x[1], x[0]))
    first = sum(n >= own_from for _, n, _ in frequent)  # the class behind those of frequent words
    shared = {r[0]: (r[1], r[2]) for r in counts.where(F.col("n") < own_from).groupBy("class").agg(F.sum("n"), F.count("*")).collect()}
    end = first + SHARED
    below = np.array([np.log10(shared.get(k, (0, 0))[0] + ADD * (shared.get(k, (0, 0))[1] + 1)) for k in range(SHARED)])  # log10 of a shared class's smoothed total
    base = float(np.log10(total + ADD * (kinds + 1)))
    # by rank: the word's class, log10 of its smoothed count, and that of its share of a shared class
    logs = np.log10(np.array([n for _, n, _ in frequent], dtype=float) + ADD)
    class_of = np.array([i if i < first else first + c for i, (_, _, c) in enumerate(frequent)], dtype="<u2")
    share_of = np.array([0.0 if i < first else logs[i] - below[c] for i, (_, _, c) in enumerate(frequent)])
    known = spark.sparkContext.broadcast(({w: i for i, (w, _, _) in enumerate(frequent)}, class_of, logs, share_of))

    def index(batches):
        rank, class_of, logs, share_of = known.value
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for doc, t, held in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
                words = words_of(t.as_py())
                ranks = np.array([rank.get(w, -1) for w in words], dtype=np.int64)
                seen = ranks >= 0
                classes = np.full(len(words) + 1, end, dtype="<u2")
                found = ranks[seen]
                classes[:-1][seen] = class_of[found]
                base_sum = float(np.log10(texts + ADD)) + float(logs[found].sum())
                own_sum = float(share_of[found].sum())
                rare = []
                for i in np.flatnonzero(~seen).tolist():
                    rare.append(words[i])
                    s = shared_class(words[i])
                    own_sum -= float(below[s])
                    classes[i] = first + s
                rows.append((uid, doc, held, len(words) + 1, int(texts > 0) + len(found), base_sum - (len(words) + 1) * base, own_sum, classes.tobytes(), rare))
                uid += 1
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", "classes", "rare"]
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 2000]], t) for k, t in enumerate(kinds)], names=names)

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, classes binary, rare array<binary>"
    stored = materialise(docs.mapInArrow(index, schema), "indexed")
    learn = stored.where(~F.col("held_out")).select("classes")

    frequency = np.zeros(end + 1)
    frequency[:first] = [n for _, n, _ in frequent[:first]]
    frequency[first:end] = [shared.get(k, (0, 0))[0] for k in range(SHARED)]
    frequency[end] = texts
    model = Hmm.begin(states, frequency)
    for _ in range(rounds if texts else 0):
        sent = spark.sparkContext.broadcast(model)

        def expect(batches, sent=sent):
            m, held = sent.value, None
            for b in batches:
                got = m.expect(_arrays(b.column(0)))
                held = got if held is None else tuple(x + y for x, y in zip(held, got))
            if held is not None:
                table = np.concatenate([held[2], held[1], held[0][None, :]])
                seen = np.flatnonzero(table.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(table[seen, s]) for s in range(states)]], names=["row", *[f"s{s}" for s in range(states)]])

        spec = ", ".join(["row int", *[f"s{s} double" for s in range(states)]])
        summed = learn.mapInArrow(expect, spec).groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toArrow()
        full = np.zeros((end + 1 + states + 1, states))
        full[summed["row"].to_numpy()] = np.stack([summed[f"s{s}"].to_numpy() for s in range(states)], axis=1)
        model = Hmm.estimate(full[-1], full[end + 1 : -1], full[: end + 1])

    last = spark.sparkContext.broadcast(model)

    def likelihood(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(last.value.likelihood(_arrays(b.column(7))))], names=[*b.schema.names[:7], "chain"])

    scored = stored.drop("rare").mapInArrow(likelihood, schema.replace("classes binary, rare array<binary>", "chain double"))
    rare = stored.select("uid", F.explode("rare").alias("word")).join(counts.where(F.col("n") < head_from).select("word", "n"), "word", "left")
    sums = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_sum"), F.count("n").alias("rare_known"))
    s = F.coalesce("rare_sum", F.lit(0.0))
    return scored.join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + s).alias("base_score"), (F.col("chain") + F.col("own") + s).alias("score"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs.withColumn("held_out", F.coalesce(crc_bucket("doc_id", 10) == 0, F.lit(False))))
