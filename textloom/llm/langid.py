"""Language identification by interpolated Kneser-Ney character models.

One model per language over lower-cased letters, everything else being one space. Its highest order counts n-grams, its
lower orders count distinct continuations. Each n-gram is four 16-bit characters in one long (beyond the basic plane, the
low bits), and the n-grams of all languages stand in one sorted array beside a matrix of log probabilities, so that a text
takes one binary search a character, and one more for each order it backs off.

A text gets the language of the lowest cross-entropy per character. It is rejected where it has no letter, or where that
cross-entropy is further from the language's usual one than calibration allows; the distance shrinks with the root of the text's length. The
cut comes from labelled documents that the models are not fitted on: the conformal quantile of their distances at a stated rate of
false rejections, by language where there are rows enough for that rate, else of all together, times a margin.

Models are fitted on a bounded sample: about `sample` labelled documents a language, chosen by a hash of doc_id; about CALIBRATION of them calibrate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, share_code, spread, table

ORDER = 4
#: Documents a language that models are fitted on, about; and one in so many of them calibrates instead.
SAMPLE, CALIBRATE = 1500, 4
#: Labelled documents a language that calibrate, about: the held ones of the sample, and more beside it.
CALIBRATION = 6000
#: Characters beyond which a longer text is no surer. The usual deviation is that of the inner TRIM of the rows.
LONGEST, TRIM, FEW = 500, 0.95, 20
#: Calibration documents that may be beyond the quantile, as a share, and how far beyond it a text is rejected: documents of a learned language are then rejected less often.
REJECTED, MARGIN = 0.001, 1.5
SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of each code point the low bits of its lower case, or a space where it is no letter."""
    if not _letters:
        out = np.full(0x110000, 32, dtype=np.uint16)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                out[c] = ord(s.lower()[0]) & 0xFFFF
        _letters.append(out)
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each character, and how many each text has (none where it has no letter)."""
    codes, sizes = [], []
    for text in texts:
        x = letters().take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        gap = x == 32
        x = x[~(gap & np.concatenate([[True], gap[:-1]]))].astype(np.uint64)
        if not len(x):
            sizes.append(0)
            continue
        x = np.concatenate([np.full(ORDER - 1, 32, dtype=np.uint64), x, [np.uint64(32)] * int(x[-1] != 32)]).astype(np.uint64)
        n = len(x) - ORDER + 1
        code = x[:n].copy()
        for i in range(1, ORDER):
            code = code << np.uint64(16) | x[i : i + n]
        codes.append(code)
        sizes.append(n)
    return np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def _low(codes: np.ndarray, n: int) -> np.ndarray:
    return codes & np.uint64((1 << 16 * n) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the wanted are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool))


class KneserNey:
    """One language's model, from its n-grams and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.base, self.levels = 1.0 / alphabet, {}
        for n in range(ORDER, 0, -1):
            if n < ORDER:  # how many different characters stand before
                keys, counts = np.unique(_low(self.levels[n + 1][0], n), return_counts=True)
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, first = np.unique(keys >> np.uint64(16), return_index=True)
            sums, kinds = np.add.reduceat(counts, first).astype(float), np.diff(np.append(first, len(keys))).astype(float)
            self.levels[n] = (keys, counts.astype(float), contexts, sums, kinds, discount)

    def rest(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """The weight of the lower order behind a context."""
        _, _, known, sums, kinds, d = self.levels[n]
        at, hit = _find(known, contexts)
        return np.where(hit, d * kinds[at] / sums[at], 1.0)

    def prob(self, n: int, codes: np.ndarray) -> np.ndarray:
        if n == 0:
            return np.full(len(codes), self.base)
        keys, counts, known, sums, _, d = self.levels[n]
        lower = self.prob(n - 1, _low(codes, n - 1))
        at, hit = _find(keys, codes)
        ctx, seen = _find(known, codes >> np.uint64(16))
        return np.where(hit, (counts[at] - d) / sums[ctx], 0.0) * seen + self.rest(n, codes >> np.uint64(16)) * lower


class Models:
    """All languages in shared sorted arrays."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counted)
        alphabet = len(np.unique(np.concatenate([_low(k, 1) for k, _ in counted.values()]))) + 1
        own = [KneserNey(*counted[x], alphabet) for x in self.names]
        self.base = math.log(1.0 / alphabet)
        self.tables = {}
        for n in range(ORDER, 0, -1):
            keys = np.unique(np.concatenate([m.levels[n][0] for m in own]))
            contexts = np.unique(np.concatenate([m.levels[n][2] for m in own]))
            self.tables[n] = (keys, np.stack([np.log(m.prob(n, keys)) for m in own], 1).astype(np.float32), contexts, np.stack([np.log(m.rest(n, contexts)) for m in own], 1).astype(np.float32))
        self.usual = {x: (0.0, float("inf"), float("inf")) for x in self.names}

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last character, a column per language."""
        out = np.zeros((len(codes), len(self.names)), dtype=np.float32)
        left = np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            keys, logp, contexts, rest = self.tables[n]
            code = _low(codes[left], n)
            at, hit = _find(keys, code)
            out[left[hit]] += logp[at[hit]]
            left, code = left[~hit], code[~hit] >> np.uint64(16)
            at, hit = _find(contexts, code)
            out[left[hit]] += rest[at[hit]]
        out[left] += self.base
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the characters."""
        out, sizes = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), dtype=np.int64)
        at, step = 0, max(50_000, 2_000_000 // len(self.names))
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (not held or held + len(texts[end]) <= step):
                held += len(texts[end])
                end += 1
            codes, n = grams(texts[at:end])
            sizes[at:end] = n
            if len(codes):
                parts = [self.logs(codes[i : i + step]) for i in range(0, len(codes), step)]
                some = np.flatnonzero(n)
                starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                logs = parts[0] if len(parts) == 1 else np.concatenate(parts)
                out[at + some] = -np.add.reduceat(logs.astype(np.float64), starts, axis=0) / n[some, None]
            at = end
        return out, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy and whether rejected, of each text."""
        ce, sizes = self.entropies([t or "" for t in texts])
        rows: list = []
        for i, n in enumerate(sizes.tolist()):
            if not n:
                rows.append(("und", 0.0, None, True))
                continue
            best = int(ce[i].argmin())
            name, least = self.names[best], float(ce[i, best])
            score = 1.0 / float(np.exp(-(ce[i] - least) * min(n, LONGEST)).sum())
            rows.append((name, score, least, self.away(name, least, n) > self.usual[name][2]))
        return rows

    def away(self, name: str, entropy: float, n: int) -> float:
        """How far a text's cross-entropy is above the usual, in deviations at its length."""
        mean, scale, _ = self.usual[name]
        return (entropy - mean) * math.sqrt(min(n, LONGEST)) / scale

    def calibrate(self, seen: list[tuple[str, float, int]]) -> None:
        """From (language, its cross-entropy, characters) of documents that models were not fitted on, and that they find to be of it.

        Each language on its own rows: its mean and deviation are those of the TRIM share nearest to its median, so a few odd rows move
        nothing. The distances of all its rows, in deviations, have a conformal quantile, which a further document of the language exceeds
        with a chance of REJECTED; the cut is MARGIN times that. A language of fewer than 1 / REJECTED rows has the quantile of all rows, or where
        these are as few the largest distance; one of fewer than FEW has their deviation, too, and without a row the highest mean.
        """
        rows = {x: np.array([(e, min(n, LONGEST)) for y, e, n in seen if y == x and n], dtype=float).reshape(-1, 2) for x in self.names}
        middles = {x: float(np.median(r[:, 0])) if len(r) else 0.0 for x, r in rows.items()}
        if sum(map(len, rows.values())) < FEW:  # nothing to tell by
            self.usual = {x: (0.0, float("inf"), float("inf")) for x in self.names}
            return

        def usual(r: np.ndarray, middle) -> tuple[float, float]:
            """Mean and deviation at one character."""
            off = np.abs(r[:, 0] - middle) * np.sqrt(r[:, 1])
            near = off <= np.quantile(off, TRIM)
            mean = float(np.average(r[near, 0] - (middle if np.ndim(middle) == 0 else middle[near]), weights=r[near, 1]))
            return mean, max(1e-6, float(np.sqrt(np.mean((np.abs(r[near, 0] - (middle if np.ndim(middle) == 0 else middle[near]) - mean) ** 2) * r[near, 1]))))

        def quantile(distances: np.ndarray) -> float:
            at = min(len(distances), math.ceil((len(distances) + 1) * (1 - REJECTED)))
            return float(np.sort(distances)[at - 1])

        pooled = usual(np.concatenate(list(rows.values())), np.concatenate([np.full(len(r), middles[x]) for x, r in rows.items()]))[1]
        own = {x: usual(r, middles[x]) for x, r in rows.items() if len(r) >= FEW}
        self.usual = {x: (middles[x] + own[x][0], own[x][1], 0.0) if x in own else (middles[x] if len(r) else max(middles.values()), pooled, 0.0) for x, r in rows.items()}
        away = {x: np.array([self.away(x, e, int(n)) for e, n in r]) for x, r in rows.items()}
        together = quantile(np.concatenate(list(away.values())))
        self.usual = {x: (mean, scale, MARGIN * max(0.0, quantile(away[x]) if len(away[x]) >= 1 / REJECTED else together)) for x, (mean, scale, _) in self.usual.items()}


def fit(docs: DataFrame, sample: int = SAMPLE) -> Models | None:
    """Models from labelled rows (doc_id, text, lang); None if there are none."""
    spark = docs.sparkSession
    share_code(spark)
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # no text is read for the totals
    totals = docs.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()
    if not totals:
        return None
    rate = F.create_map(*[x for lang, n in totals for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = labelled.where(chance < rate[F.col("lang")])
    held: Column = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATE)) == 0
    wider = F.create_map(*[x for lang, n in totals for x in (F.lit(lang), F.lit(min(1.0, (sample + CALIBRATION) / n)))])

    def count(batches):
        for b in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                keys, n = np.unique(grams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = chosen.where(~held).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:  # a handful of rows, all held: fit on them
        held = F.lit(False)  # and calibrate by none
        counts = chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    names, keys, n = np.array(counts["lang"].to_pylist()), counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    counted = {}
    for x in np.unique(names).tolist():
        mine = names == x
        order = np.argsort(keys[mine])
        counted[x] = (keys[mine][order], n[mine][order])
    models = Models(counted)
    beside = labelled.where((chance < wider[F.col("lang")]) & (held | (chance >= rate[F.col("lang")])))  # none of the rows that models are fitted on
    sent = spark.sparkContext.broadcast(models)

    def entropy(batches):
        m = sent.value
        for b in batches:
            langs = b.column(1).to_pylist()
            ce, sizes = m.entropies(b.column(0).to_pylist())
            own = [float(ce[i].min()) if x in m.names and ce[i].argmin() == m.names.index(x) else None for i, x in enumerate(langs)]  # others may be mislabelled
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.float64()), pa.array(sizes)], names=["lang", "e", "n"])

    models.calibrate([tuple(r) for r in beside.select("text", "lang").mapInArrow(entropy, "lang string, e double, n long").where("e IS NOT NULL").collect()])
    return models


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score, cross_entropy (nats per character) and rejected.

    Null texts and those without a letter are `und`, score 0, rejected. Without models (no labelled row) every text is `und`
    and those with a letter are not rejected. Only the text decides; repeated rows get equal answers.
    """
    spark = docs.sparkSession
    share_code(spark)
    if models is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), (~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).alias("rejected"))
    sent = spark.sparkContext.broadcast(models)

    def run(batches):
        m = sent.value
        for b in batches:
            rows = m.predict(b.column(1).to_pylist())
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return spread(docs.select("doc_id", "text"), "doc_id", per_core=1).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, models: Models | None) -> DataFrame:
    """The rows that identify() does not reject, each by its own text, with all their columns."""
    spark = docs.sparkSession
    share_code(spark)
    if models is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    sent = spark.sparkContext.broadcast(models)
    at = docs.columns.index("text")

    def run(batches):
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([not r[3] for r in m.predict(b.column(at).to_pylist())], pa.bool_()))

    return spread(docs, per_core=1).mapInArrow(run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
