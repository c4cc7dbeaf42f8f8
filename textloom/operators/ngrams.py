"""Interpolated Witten-Bell character models as joins.

One table of the longest n-grams of the training texts gives all shorter ones, since each position has one n-gram of each
length. Scored positions are collapsed to distinct n-grams with a multiplicity before any join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import windows
from . import scan
from .overlap import PART, Sums

#: Stands before a text's first character; no text holds it.
PAD = "\x01"


def padded(df: DataFrame, order: int, *keep: str) -> DataFrame:
    """keep, pos, piece: the n-gram that ends at each character. Never across texts."""
    text = F.concat(F.lit(PAD * (order - 1)), F.col("text"))
    return windows(df.where(F.length("text") > 0).select(*keep, text.alias("text")), order, *keep)


def gram_counts(training: DataFrame, order: int) -> DataFrame:
    """piece, n."""
    return counted(training, order)


def levels(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each length from 1: (gram, n), and (context, total, kinds)."""
    out = []
    for k in range(1, order + 1):
        grams = counts.groupBy(F.expr(f"right(piece, {k})").alias("gram")).agg(F.sum("n").alias("n"))
        contexts = grams.groupBy(F.expr(f"left(gram, {k - 1})").alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        out.append((grams, contexts))
    return out


def probabilities(pieces: DataFrame, counts: DataFrame, order: int, alphabet: int) -> DataFrame:
    """Adds p1 .. p{order} to rows with a piece: an unseen context keeps the shorter context's probability."""
    p = F.lit(1.0 / alphabet)
    for k, (grams, contexts) in enumerate(levels(counts, order), start=1):
        gram = F.expr(f"right(piece, {k})")
        pieces = pieces.withColumn("gram", gram).join(grams.hint("merge"), "gram", "left").drop("gram")
        if k == 1:
            pieces = pieces.crossJoin(F.broadcast(contexts.drop("context")))  # one row
        else:
            pieces = pieces.withColumn("context", F.expr(f"left(right(piece, {k}), {k - 1})")).join(contexts.hint("merge"), "context", "left").drop("context")
        here = (F.coalesce("n", F.lit(0)) + F.col("kinds") * p) / (F.col("total") + F.col("kinds"))
        pieces = pieces.withColumn(f"p{k}", F.when(F.col("total").isNotNull(), here).otherwise(p)).drop("n", "total", "kinds")
        p = F.col(f"p{k}")
    return pieces


def alphabet_size(df: DataFrame) -> int:
    """Different characters of all texts: a number for the driver."""
    return piece_parts(df, 1, pad="").select("piece").distinct().count()


def score(held: DataFrame, training: DataFrame, order: int, alphabet: int, *groups: str) -> DataFrame:
    """groups, n_chars and bits1 .. bits{order}, summed. Divide once, at the end."""
    pieces = padded(held, order, *groups).groupBy(*groups, "piece").agg(F.count("*").alias("times"))
    scored = probabilities(pieces, gram_counts(training, order), order, alphabet)
    return scored.groupBy(*groups).agg(F.sum("times").alias("n_chars"), *[F.sum(-F.log2(f"p{k}") * F.col("times")).alias(f"bits{k}") for k in range(1, order + 1)])


# ---- hashes of n-grams

_SALT = 0x9E3779B97F4A7C15


def _salted(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of one order, apart from those of the others."""
    return (hashes ^ np.uint64(k * _SALT & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)


def _by_order(texts: list, order: int):
    """Parts of the texts: (their rows, the row of each character, and for each order the hashes of its n-gram and of what comes before it)."""
    rows, pieces, held = [], [], 0
    cuts = [(row, begin, text[max(0, begin - order + 1) : begin + PART]) for row, text in enumerate(texts) if text for begin in range(0, len(text), PART)]
    for n, (row, begin, piece) in enumerate(cuts):
        pad = PAD * (order - 1 - min(begin, order - 1))
        pieces.append(np.frombuffer((pad + piece).encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        rows.append(row)
        held += len(piece)
        if held < PART and n + 1 < len(cuts):
            continue
        sizes = np.array([len(p) for p in pieces])
        sums, codes = Sums(np.concatenate(pieces)), int(sizes.sum())
        first = np.ones(codes, dtype=bool)  # not the characters that only stand before
        for at in np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist():
            first[at : at + order - 1] = False
        at = np.flatnonzero(first)
        yield np.repeat(np.array(rows), sizes)[at], [(_salted(sums.hashes(at - k + 1, k, 0), k), _salted(sums.hashes(at - k + 1, k - 1, 0), k)) for k in range(1, order + 1)]
        rows, pieces, held = [], [], 0


# ---- many orders at once, along texts or by hashes

#: Rows of a table of n-grams that tasks may hold; characters whose n-grams are counted at once.
SENT, COUNTED = 2_000_000, 2_000_000
#: The longest n-grams whose table is sent.
LOW = 3
#: Different n-grams that a task holds while it counts, and training characters for each part in which contexts meet.
HELD, PER_PART = 8_000_000, 1 << 22


def _laid(texts: list, order: int, pad: str, end: str = ""):
    """Parts of the texts: code points, where n-grams end among them, and the row and position of each such end. Long texts are cut."""
    cuts = [(row, at) for row, text in enumerate(texts) if text for at in range(0, len(text) + len(end), COUNTED)]
    codes, ends, rows, places, held = [], [], [], [], 0
    for n, (row, begin) in enumerate(cuts):
        text = texts[row] + end
        piece = text[max(0, begin - order + 1) : begin + COUNTED]
        piece, skipped = pad * max(0, order - 1 - begin) + piece, begin if pad or begin else order - 1
        own = np.frombuffer(piece.encode("utf-32-be", "surrogatepass"), dtype=">u4").astype(np.uint32)
        at = np.arange(order - 1, len(own))
        codes.append(own)
        ends.append(at + held)
        rows.append(np.full(len(at), row))
        places.append(at - (order - 1) + skipped)
        held += len(own)
        if held >= COUNTED or n + 1 == len(cuts):
            yield tuple(map(np.concatenate, (codes, ends, rows, places)))
            codes, ends, rows, places, held = [], [], [], [], 0


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of these columns of numbers, equal where the rows are: packed where they fit, else ranked column by column."""
    key, size = columns[0].astype(np.uint64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if size * wide >= 1 << 64:
            kinds, key = np.unique(key, return_inverse=True)
            key, size = key.astype(np.uint64), len(kinds)
        key, size = key * np.uint64(wide) + c.astype(np.uint64), size * wide
    return key


def _dense(codes: np.ndarray) -> np.ndarray:
    """Code points as small numbers."""
    there = np.zeros(0x110000, dtype=bool)
    there[codes] = True
    return (np.cumsum(there) - 1)[codes]


def _binary(codes: np.ndarray, ends: np.ndarray, order: int) -> pa.Array:
    """The n-grams that end there, as UTF-32."""
    flat = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, order)[ends - (order - 1)].astype(">u4"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * order), len(ends), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _codes(pieces, order: int) -> np.ndarray:
    """The code points of n-grams, a row each."""
    pieces = pieces.combine_chunks() if isinstance(pieces, pa.ChunkedArray) else pieces
    return np.frombuffer(b"".join(pieces.to_pylist()), dtype=">u4").astype(np.int64).reshape(-1, order)


def piece_parts(df: DataFrame, order: int, *groups: str, pad: str = PAD, end: str = "") -> DataFrame:
    """groups, piece (UTF-32), n: the n-grams of texts, counted by parts of texts, so that a piece has a row for each part that has it."""
    schema = df.select(*groups).schema

    def run(batches):
        for b in batches:
            alike = _alike(b, len(groups))
            for codes, ends, rows, _ in _laid(b.column(len(groups)).to_pylist(), order, pad, end):
                dense = _dense(codes)
                _, first, n = np.unique(_keys([*(dense[ends - i] for i in range(order)), alike[rows]]), return_index=True, return_counts=True)
                for at in range(0, len(first), 100_000):
                    some = first[at : at + 100_000]
                    columns = [b.column(c).take(pa.array(rows[some])) for c in range(len(groups))]
                    yield pa.RecordBatch.from_arrays([*columns, _binary(codes, ends[some], order), pa.array(n[at : at + 100_000])], names=[*schema.names, "piece", "n"])

    return df.select(*groups, "text").mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["piece binary", "n long"]))


def counted(df: DataFrame, order: int, pad: str = PAD, end: str = "") -> DataFrame:
    """piece, n."""
    return piece_parts(df, order, pad=pad, end=end).groupBy("piece").agg(F.sum("n").alias("n")).select(F.decode("piece", "UTF-32").alias("piece"), "n")


def _alike(batch, groups: int) -> np.ndarray:
    """For each row the first one's number that has its values."""
    seen: dict = {}
    rows = zip(*(batch.column(c).to_pylist() for c in range(groups))) if groups else [()] * len(batch)
    return np.array([seen.setdefault(x, i) for i, x in enumerate(rows)], dtype=np.int64)


class Levels:
    """Counts of all n-grams up to an order as arrays: probabilities of n-grams (code points, a row each), an array for each order."""

    def __init__(self, pieces: np.ndarray, n: np.ndarray, alphabet: int):
        self.order, self.alphabet = pieces.shape[1], alphabet
        self.letters = np.union1d(pieces, [ord(PAD)])
        ids, self.grams, self.contexts = self._ids(pieces), [], []
        for k in range(1, self.order + 1):
            grams, first, of = np.unique(self._key(ids[:, -k:]), return_index=True, return_inverse=True)
            self.grams.append((grams, np.bincount(of, n, len(grams))))
            contexts, of_gram = np.unique(self._key(ids[first, -k:-1] if k > 1 else ids[first, :0]), return_inverse=True)
            self.contexts.append((contexts, np.bincount(of_gram, self.grams[-1][1], len(contexts)), np.bincount(of_gram, minlength=len(contexts))))

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        """Numbers from 1; 0 for a character that is in no counted n-gram."""
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0).astype(np.uint64)

    def _key(self, ids: np.ndarray) -> np.ndarray:
        key = np.zeros(len(ids), dtype=np.uint64)  # LOW letters of any alphabet fit
        for c in range(ids.shape[1]):
            key = key * np.uint64(len(self.letters) + 1) + ids[:, c]
        return key

    def of(self, codes: np.ndarray) -> list[np.ndarray]:
        return self.of_ids(self._ids(codes))

    def of_ids(self, ids: np.ndarray) -> list[np.ndarray]:
        p, out = np.full(len(ids), 1 / self.alphabet), []
        for k, ((grams, n), (contexts, total, kinds)) in enumerate(zip(self.grams, self.contexts), start=1):
            if len(grams):
                found = lambda held, key: (at := np.minimum(np.searchsorted(held, key), len(held) - 1), held[at] == key)
                at, known = found(grams, self._key(ids[:, -k:]))
                c, seen = found(contexts, self._key(ids[:, -k:-1] if k > 1 else ids[:, :0]))
                p = np.where(seen, (np.where(known, n[at], 0) + kinds[c] * p) / (total[c] + kinds[c]), p)
            out.append(p)
        return out


def levels_of(training: DataFrame, order: int, alphabet: int) -> Levels | None:
    """The counts of orders up to `order`, LOW at most, if their table is small enough to be sent; else None."""
    found = piece_parts(training, order).groupBy("piece").agg(F.sum("n").alias("n")).limit(SENT + 1).toArrow()
    return Levels(_codes(found["piece"], order), found["n"].to_numpy(), alphabet) if len(found) <= SENT else None


def score_orders(held: DataFrame, training: DataFrame, order: int, alphabet: int, *groups: str, block: int | None = None) -> DataFrame:
    """As score(), for many orders: all of them are counted and scored together; with `block`, also by blocks of so many positions (column block).

    Up to order LOW the table of n-grams goes to the tasks, which score with it along the texts. Longer ones meet by their contexts, and a table that
    no task may hold is joined.
    """
    if order > LOW and block:
        return _joined(held, training, order, alphabet, *groups, block=block)
    if order > LOW:
        low, table = next((k, t) for k in range(LOW, 0, -1) if (t := levels_of(training, k, alphabet)))  # an alphabet always fits
        return _by_context(held, training, training.sparkSession.sparkContext.broadcast(table), low, order, *groups)
    table = levels_of(training, order, alphabet)
    if table is None:
        return _joined(held, training, order, alphabet, *groups, block=block)
    bits = [f"bits{k}" for k in range(1, order + 1)]
    out = _along(held, training.sparkSession.sparkContext.broadcast(table), order, groups, block)
    names = [*groups, *(["block"] if block else [])]
    return out.groupBy(*names).agg(F.sum("n_chars").alias("n_chars"), *[F.sum(c).alias(c) for c in bits])


def _joined(held: DataFrame, training: DataFrame, order: int, alphabet: int, *groups: str, block: int | None = None) -> DataFrame:
    if not block:
        return score(held, training, order, alphabet, *groups)
    pieces = padded(held, order, *groups).withColumn("block", F.floor(F.col("pos") / block)).groupBy(*groups, "block", "piece").agg(F.count("*").alias("times"))
    scored = probabilities(pieces, gram_counts(training, order), order, alphabet)
    return scored.groupBy(*groups, "block").agg(F.sum("times").alias("n_chars"), *[F.sum(-F.log2(f"p{k}") * F.col("times")).alias(f"bits{k}") for k in range(1, order + 1)])


def _along(held: DataFrame, sent, order: int, groups: tuple[str, ...], block: int | None) -> DataFrame:
    """Sums of each text's bits, or of each of its blocks."""
    schema, names = held.select(*groups).schema, [f"bits{k}" for k in range(1, order + 1)]

    def run(batches):
        for b in batches:
            for codes, ends, rows, places in _laid(b.column(len(groups)).to_pylist(), order, PAD):
                dense = _dense(codes)
                _, first, of = np.unique(_keys([dense[ends - i] for i in range(order)]), return_index=True, return_inverse=True)
                bits = [-np.log2(p) for p in sent.value.of(np.lib.stride_tricks.sliding_window_view(codes, order)[ends[first] - (order - 1)])]
                begins = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(places // block if block else rows) != 0)))
                columns = [b.column(c).take(pa.array(rows[begins])) for c in range(len(groups))]
                columns += [pa.array(places[begins] // block)] if block else []
                columns += [pa.array(np.diff(np.append(begins, len(rows)))), *(pa.array(np.add.reduceat(x[of], begins)) for x in bits)]
                yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, *(["block"] if block else []), "n_chars", *names])

    spec = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + (["block long"] if block else []) + ["n_chars long", *(f"{c} double" for c in names)]
    return held.select(*groups, "text").mapInArrow(run, ", ".join(spec))


def each_character(held: DataFrame, training: DataFrame, alphabet: int, key: str) -> DataFrame:
    """key, pos (from 0), bits, is_letter of each character under single-character counts, in the order of each text."""
    alike = piece_parts(held, 1, pad="").select(F.decode("piece", "UTF-32").alias("ch")).distinct().where(F.regexp_like("ch", F.lit(r"\p{L}")))
    letters = np.array([ord(r[0]) for r in alike.collect()], dtype=np.uint32)  # an alphabet
    sent = training.sparkSession.sparkContext.broadcast(levels_of(training, 1, alphabet))

    def run(batches):
        for b in batches:
            for codes, ends, rows, places in _laid(b.column(1).to_pylist(), 1, ""):
                kinds, of = np.unique(codes, return_inverse=True)
                bits, is_letter = -np.log2(sent.value.of(kinds[:, None])[0]), np.isin(kinds, letters)
                for at in range(0, len(ends), 200_000):
                    some = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[some])), pa.array(places[some]), pa.array(bits[of[some]]), pa.array(is_letter[of[some]])], names=[key, "pos", "bits", "is_letter"])

    return held.select(key, "text").mapInArrow(run, f"`{key}` {held.schema[key].dataType.simpleString()}, pos long, bits double, is_letter boolean")


def agreement(held: DataFrame, best: DataFrame, key: str, least: int = 0) -> DataFrame:
    """key, n, agreed: a text's characters, and those that stand as `next` behind the two before them (ctx) in `best`; with `least`, key, begin, length of runs of at least so many.

    A table of up to SENT rows goes to the tasks, which go along the texts, each of which has a row. A larger one is joined.
    """
    found = best.select("ctx", "next").limit(SENT + 1).toArrow()
    if len(found) > SENT:
        seen = padded(held, 3, key).withColumns({"ctx": F.expr("left(piece, 2)"), "ch": F.expr("right(piece, 1)")}).join(best, "ctx", "left")
        told = seen.select(key, "pos", F.coalesce(F.col("ch") == F.col("next"), F.lit(False)).alias("agreed"))
        return scan.runs(told.where("agreed"), key, least) if least else told.groupBy(key).agg(F.count("*").alias("n"), F.count_if("agreed").alias("agreed"))
    codes = lambda c: np.frombuffer("".join(found[c].to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    contexts = (ctx := codes("ctx"))[0::2] << 21 | ctx[1::2]
    by = np.argsort(contexts)
    sent = held.sparkSession.sparkContext.broadcast((contexts[by], codes("next")[by]))
    schema, names = held.select(key).schema, ["begin", "length"] if least else ["n", "agreed"]

    def run(batches):
        known, following = sent.value
        for b in batches:
            open_ = None  # a run that reached the end of a part: row, begin, length
            for own, ends, rows, places in _laid(b.column(1).to_pylist(), 3, PAD):
                own = own.astype(np.int64)
                ctx = own[ends - 2] << 21 | own[ends - 1]
                at = np.minimum(np.searchsorted(known, ctx), max(0, len(known) - 1))
                hit = (known[at] == ctx) & (following[at] == own[ends]) if len(known) else np.zeros(len(ends), dtype=bool)
                if not least:
                    begins = np.flatnonzero(np.append(True, np.diff(rows) != 0))
                    columns = [rows[begins], np.diff(np.append(begins, len(rows))), np.add.reduceat(hit.astype(np.int64), begins)]
                else:
                    place = np.flatnonzero(hit)
                    first = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(rows[place]) != 0))) if len(place) else place
                    columns = [rows[place[first]], places[place[first]], np.diff(np.append(first, len(place)))]
                    if open_:
                        row, begin, length = open_
                        if len(first) and (columns[0][0], columns[1][0]) == (row, begin + length):
                            columns[1][0], columns[2][0] = begin, length + columns[2][0]
                        else:
                            columns = [np.append(x, y) for x, y in zip(open_, columns)]
                    open_ = None
                    if len(place) and place[-1] == len(hit) - 1:  # it may go on
                        open_, columns = tuple(int(x[-1]) for x in columns), [x[:-1] for x in columns]
                    kept = columns[2] >= least
                    columns = [x[kept] for x in columns]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0])), pa.array(columns[1]), pa.array(columns[2])], names=[key, *names])
            if open_ and open_[2] >= least:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([open_[0]])), pa.array([open_[1]]), pa.array([open_[2]])], names=[key, *names])

    out = held.select(key, "text").mapInArrow(run, f"`{key}` {schema[0].dataType.simpleString()}, {names[0]} long, {names[1]} long")
    return out if least else out.groupBy(key).agg(F.sum("n").alias("n"), F.sum("agreed").alias("agreed"))


class Packed:
    """N-grams as a few 64-bit words: what is before a character, the nearest first, then the character. So contexts of all lengths are prefixes."""

    def __init__(self, letters: np.ndarray, order: int):
        self.letters, self.order = letters, order
        self.wide = max(1, len(letters).bit_length())
        self.per = 64 // self.wide  # 3 at least, as there are 2^21 code points
        self.words = -(-order // self.per)

    def ids(self) -> np.ndarray:
        """For each code point its number from 1; 0 for what is in no text that was counted."""
        out = np.zeros(0x110000, dtype=np.uint64)
        out[self.letters] = np.arange(1, len(self.letters) + 1)
        return out

    def pack(self, ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(ends), dtype=np.uint64) for _ in range(self.words)]
        for i in range(self.order):
            out[i // self.per] |= ids[ends - (i + 1 if i < self.order - 1 else 0)] << self._shift(i)
        return out

    def _shift(self, i: int) -> np.uint64:
        return np.uint64((self.per - 1 - i % self.per) * self.wide)

    def at(self, words: list[np.ndarray], i: int) -> np.ndarray:
        return words[i // self.per] >> self._shift(i) & np.uint64((1 << self.wide) - 1)

    def last(self, words: list[np.ndarray], k: int) -> np.ndarray:
        """The numbers of the last k characters, a row each."""
        return np.stack([self.at(words, i) for i in [*range(k - 2, -1, -1), self.order - 1]], axis=1)

    def fresh(self, words: list[np.ndarray], n: int) -> np.ndarray:
        """Of sorted n-grams, those whose n nearest characters before differ from their neighbour's."""
        out = np.zeros(len(words[0]), dtype=bool)
        out[:1] = True
        for w in range(-(-n // self.per)):
            x = words[w] if n >= (w + 1) * self.per else words[w] >> self._shift(n - 1)
            out[1:] |= x[1:] != x[:-1]
        return out


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of these columns, sorted, and the sum of n for each."""
    by = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    columns, first = [c[by] for c in columns], np.zeros(len(by), dtype=bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.add.reduceat(n[by], at) if len(at) else n[:0]


def _packed(df: DataFrame, packed: Packed, low: int, parts: int, *groups: str) -> DataFrame:
    """part, words, of, n, and each of the groups as a list (list0 ..): a task's different n-grams with their counts. Equal contexts of `low` characters share a part.

    A task's n-grams are summed as it reads on, up to HELD of them, so what leaves grows with the different ones. `of` is the place of an n-gram's values in the lists.
    """
    schema, names = df.select(*groups).schema, ["part", "words", "of", "n", *(f"list{c}" for c in range(len(groups)))]

    def told(columns, n, values, lists_of):
        mixed = columns[0] >> packed._shift(low - 1)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(_SALT)
        part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(part[by]) != 0)), len(by))
        for at in range(0, len(cuts) - 1, 64):  # some parts a batch
            rows = []
            for i, j in zip(cuts[at : at + 64], cuts[at + 1 : at + 65]):
                own = by[i:j]
                kinds, of = np.unique(columns[-1][own], return_inverse=True) if groups else ([], [])
                # bytes of one place together: neighbours share most of them
                planes = [np.ascontiguousarray(x[own].view(np.uint8).reshape(-1, 8).T).tobytes() for x in [*columns[: packed.words], n]]
                rows.append((int(part[own[0]]), b"".join(planes[:-1]), np.asarray(of, dtype=np.int32).tobytes(), planes[-1], [[values[v][c] for v in kinds] for c in range(len(groups))]))
            lists = [pa.array([r[4][c] for r in rows], kind) for c, kind in enumerate(lists_of)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)), *lists], names=names)

    def run(batches):
        ids, runs, waiting, values = packed.ids(), [], 0, {}
        for b in batches:
            lists_of = [pa.list_(b.column(c).type) for c in range(len(groups))]
            own = np.array([values.setdefault(x, len(values)) for x in zip(*(b.column(c).to_pylist() for c in range(len(groups))))], dtype=np.uint64)
            for codes, ends, rows, _ in _laid(b.column(len(groups)).to_pylist(), packed.order, PAD):
                columns = packed.pack(ids[codes], ends) + ([own[rows]] if groups else [])
                if len(columns) == 1:
                    x = np.sort(columns[0])
                    at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                    runs.append(([x[at]], np.diff(np.append(at, len(x)))))
                else:
                    runs.append(_summed(columns, np.ones(len(ends), dtype=np.int64)))
                waiting += len(runs[-1][1])
                if waiting > max(len(runs[0][1]), COUNTED) * 2 or waiting > HELD:
                    runs = [_summed([np.concatenate(x) for x in zip(*(c for c, _ in runs))], np.concatenate([n for _, n in runs]))]
                    waiting = len(runs[0][1])
                if waiting > HELD // 2:
                    yield from told(*runs[0], list(values), lists_of)
                    runs, waiting = [], 0
            if not runs:
                values = {}
        if runs:
            yield from told(*_summed([np.concatenate(x) for x in zip(*(c for c, _ in runs))], np.concatenate([n for _, n in runs])), list(values), lists_of)

    spec = ["part int, words binary, of binary, n binary"] + [f"list{c} array<{f.dataType.simpleString()}>" for c, f in enumerate(schema)]
    return df.select(*groups, "text").mapInArrow(run, ", ".join(spec))


def _unpacked(rows: pa.Table, packed: Packed, groups: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words, with the place of the values among those of all rows as one more column if there are groups, and counts."""
    flat = lambda x, w: [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in np.frombuffer(x, dtype=np.uint8).reshape(w, 8, -1)]
    columns = [np.concatenate(x) for x in zip(*(flat(x, packed.words) for x in rows.column("words").to_pylist()))]
    n = np.concatenate([flat(x, 1)[0] for x in rows.column("n").to_pylist()]).view(np.int64)
    if groups:
        of = [np.frombuffer(x, dtype=np.int32) for x in rows.column("of").to_pylist()]
        before = np.append(0, np.cumsum(pc.list_value_length(rows.column(5)).to_numpy()))
        columns.append(np.concatenate([x + m for x, m in zip(of, before)]).astype(np.uint64))
    return columns, n


def _by_context(held: DataFrame, training: DataFrame, sent, low: int, order: int, *groups: str) -> DataFrame:
    """As score(), for many orders: n-grams meet by the `low` characters before the last one, and all longer orders are counted and scored there at once.

    Orders up to `low` are scored with the table that is sent. N-grams are compared as they are.
    """
    table, names, lists = sent.value, [f"bits{k}" for k in range(1, order + 1)], [f"list{c}" for c in range(len(groups))]
    packed, parts = Packed(table.letters, order), 1 + int(table.grams[0][1].sum()) // PER_PART
    theirs = _packed(training, packed, low, parts).withColumns({"own": F.lit(False)} | {x: F.lit(None).cast(f"array<{held.schema[c].dataType.simpleString()}>") for x, c in zip(lists, groups)})
    own = _packed(held, packed, low, parts, *groups).withColumn("own", F.lit(True)).select(theirs.columns)

    def meet(rows: pa.Table) -> pa.Table:
        mine = rows.filter(rows.column("own"))
        if not len(mine):
            return pa.table([pa.array([], x.type.value_type) for x in rows.columns[5:]] + [pa.array([], pa.int64())] + [pa.array([], pa.float64())] * order, names=[*lists, "n_chars", *names])
        asked, times = _unpacked(mine, packed, len(groups))
        of = asked.pop() if groups else np.zeros(len(times), dtype=np.uint64)
        if len(rows) > len(mine):
            given, n = _summed(*_unpacked(rows.filter(pc.invert(rows.column("own"))), packed, 0))
        else:
            given, n = [x[:0] for x in asked], times[:0]
        m = len(n)
        words, n = [np.concatenate(x) for x in zip(given, asked)], np.append(n, np.zeros(len(times), dtype=np.int64))
        by = np.argsort(words[0]) if packed.words == 1 else np.lexsort(words[::-1])
        words, n, place = [x[by] for x in words], n[by], np.flatnonzero(by >= m)
        which = by[place] - m
        ps = sent.value.of_ids(packed.last([x[place] for x in words], low))
        last, p = packed.at(words, order - 1), ps[-1]
        for k in range(low + 1, order + 1):
            ctx = np.cumsum(packed.fresh(words, k - 1)) - 1
            gram = ctx.astype(np.uint64) << np.uint64(packed.wide) | last
            along = np.argsort(gram, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(gram[along]) != 0))
            counts = np.add.reduceat(n[along], first)
            seen = np.empty(len(n), dtype=np.int64)
            seen[along] = np.repeat(counts, np.diff(np.append(first, len(n))))
            total, kinds = np.bincount(ctx, n), np.bincount(ctx[along[first]], counts > 0)
            c = ctx[place]
            p = np.where(total[c] > 0, (seen[place] + kinds[c] * p) / np.maximum(total[c] + kinds[c], 1), p)
            ps.append(p)
        of, times = of[which].astype(np.int64), times[which]
        sums = [np.bincount(of, times).astype(np.int64), *(np.bincount(of, -np.log2(x) * times) for x in ps)]
        return pa.table([mine.column(c).combine_chunks().flatten() for c in lists] + [pa.array(x) for x in sums], names=[*lists, "n_chars", *names])

    spec = [f"{x} {held.schema[c].dataType.simpleString()}" for x, c in zip(lists, groups)] + ["n_chars long", *(f"{c} double" for c in names)]
    scored = own.unionAll(theirs).groupBy("part").applyInArrow(meet, ", ".join(spec)).toDF(*groups, "n_chars", *names)
    return scored.groupBy(*groups).agg(F.sum("n_chars").alias("n_chars"), *[F.sum(c).alias(c) for c in names])
