"""Token counts by a finite-state compilation of a tokenizer.

The tokenizer (BPE with word ends behind a regular-expression split) becomes a deterministic transducer over UTF-8 bytes. Its
transitions carry the number of tokens that are certain once the byte is read; reading a text and adding them up gives the count, with no
token ever built.

A state inside a word holds what BPE may still do: for each recent position at which a longer token could have begun, the
last token before it, and the count there. This is finite, since tokens are, and exact: a sequence of tokens is BPE's own
if and only if each two neighbours are what BPE makes of their joined text, so each position has one last token, found
from those states alone. Around it lies the split: letters run together, digits stand alone, other characters run together,
and an apostrophe at the start of a word may begin one of the contractions; bytes of a character that is not whole yet are held.
States and transitions are made when first met and kept by the worker, a row of cells a state, a column for bytes that act alike (white
space, digits, a letter in either case). Beyond `most` states those are dropped that are not in use and that at most one byte has led on
from: the insides of rare words.

Texts are laid end to end and cut into chunks that all step at once, from an unknown state, which the first white space ends. So
most chunks' state maps are constant behind it, and what they got from their predecessor decides the count up to there only. A chunk
without white space has a real map: it is taken for the states that may come in, which are those that its predecessor's map
gives, and to begin with the state behind its predecessor's last bytes. All chunks are taken at once, until no map gives a state
that its successor lacks. The maps are then composed by doubling: in each step of the scan, spans of composed maps become twice as long.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import share_code, spread, table
from .tokens import BYTES, in_parts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: The split that this compilation stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
BETWEEN, UNKNOWN = 0, 1
#: A byte that UTF-8 never has, for a special token's place in a text.
SPECIAL = 0xFF
#: Bytes of a chunk; bytes before a chunk that a guess of its incoming state reads; rounds of maps taken for all chunks at once.
CHUNK, BEHIND, ROUNDS = 512, 48, 8


class Full(Exception):
    """No room for another state."""


_compiled: dict[str, Transducer] = {}


class Transducer:
    """counts(texts) gives the tokens of each text. most: states that tables have room for, 768 bytes each for up to 128 kinds of bytes."""

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [{}])
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or [x["type"] for x in norm.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or steps[0].get("pattern") != {"Regex": SPLIT}:
            raise ValueError("this compilation is of BPE with word ends behind the split named above")
        self.library = Tokenizer.from_file(path)
        self.nfc = normalizers.NFC().normalize_str
        suffix, byte = model["end_of_word_suffix"], {BYTES.get(b, chr(b)): b for b in range(256)}
        self.ends = self.library.model
        self.inner = models.BPE(vocab=model["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.tokens: tuple[set[bytes], set[bytes]] = (set(), set())  # inside a word, and at its end
        for t in model["vocab"]:
            last = t.endswith(suffix)
            self.tokens[last].add(bytes(byte[c] for c in (t[: -len(suffix)] if last else t)))
        self.begins = {t[:i] for t in self.tokens[0] | self.tokens[1] for i in range(len(t))} | self.tokens[1]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.fits: dict = {}
        self.characters: dict[str, tuple] = {}  # of each: the kinds and bytes of what the library's own steps make of it
        self.most = most
        self.reset()

    # ---- words

    def pair(self, left: bytes | None, right: bytes, last: bool) -> bool:
        """Whether BPE leaves the two as they are (left None: the word begins here)."""
        key = (left, right, last)
        if key not in self.fits:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            want = [right] if left is None else [left, right]
            got = (self.ends if last else self.inner).tokenize(b"".join(want).decode("latin-1").translate(BYTES))
            self.fits[key] = len(got) == len(want) and (left is None or got[0].value == left.decode("latin-1").translate(BYTES))
        return self.fits[key]

    def read(self, word: tuple, b: int) -> tuple[tuple, int]:
        """The state behind one more byte, and the tokens that became certain."""
        new, least = [], None
        for since, left, n in word:
            held = since + bytes([b])
            if least is None and held in self.tokens[0] and self.pair(left, held, False):
                least = (b"", held, n + 1)
            if held in self.begins:
                new.append((held, left, n))
        new.append(least)
        base = min(x[2] for x in new)
        return tuple((s, left, n - base) for s, left, n in new), base

    def finish(self, word: tuple) -> int:
        return next(n + 1 for since, left, n in word if since in self.tokens[1] and self.pair(left, since, True))

    def count(self, word: bytes) -> int:
        return len(self.ends.tokenize(word.decode("latin-1").translate(BYTES)))

    # ---- states

    def reset(self) -> None:
        self.states: list = []
        self.ids: dict = {}
        self.columns = np.full(256, -1, dtype=np.int64)  # of each byte met so far
        self.bytes: list[int] = []  # of each column, one of its bytes
        self.alike: dict = {}
        self.width = 128
        self.next = np.full(1024 * self.width, -1, dtype=np.int32)
        self.emit = np.zeros(1024 * self.width, dtype=np.uint16)
        self.blind = np.zeros(1024, dtype=bool)  # states that don't know their word
        self.id_of((("between",), b""))
        self.id_of((("unknown",), b""))

    def column_of(self, byte: int) -> int:
        """A new byte's column: that of one that acts alike, or the next."""
        kind: tuple = (byte,)
        if byte < 0x80:
            kind = tuple((k, self.count(t)) if k == "N" else (k, t) for k, t in self.kinds(chr(byte)))
        if kind not in self.alike:
            self.alike[kind] = len(self.bytes)
            self.bytes.append(byte)
            if len(self.bytes) > self.width:
                wide = lambda x, empty: np.hstack([x.reshape(-1, self.width), np.full((len(x) // self.width, self.width), empty, dtype=x.dtype)]).ravel()
                self.next, self.emit = wide(self.next, -1), wide(self.emit, 0)
                self.width *= 2
        return self.alike[kind]

    def id_of(self, state: tuple) -> int:
        if state not in self.ids:
            if len(self.states) >= self.most:
                raise Full
            if len(self.states) == len(self.blind):
                room = min(len(self.blind), self.most - len(self.blind))
                self.next = np.concatenate([self.next, np.full(room * self.width, -1, dtype=np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros(room * self.width, dtype=np.uint16)])
                self.blind = np.concatenate([self.blind, np.zeros(room, dtype=bool)])
            self.blind[len(self.states)] = state[0][0] == "unknown"
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def keep(self, *used: np.ndarray) -> None:
        """Drop states but those of these arrays, which are renumbered in place, and those that two bytes or more have led on from."""
        n = len(self.states)
        live = np.zeros(n, dtype=bool)
        live[[BETWEEN, UNKNOWN]] = True
        for x in used:
            live[x] = True
        if live.sum() * 2 > self.most:
            self.most *= 2  # more in use than there is room for: chunks, not text, bound them
        rows = self.next[: n * self.width].reshape(n, self.width)
        often = np.concatenate([(rows[i : i + 10_000] >= 0).sum(axis=1) >= 2 for i in range(0, n, 10_000)])
        kept = np.flatnonzero(live | often if (live | often).sum() * 4 < self.most * 3 else live)
        new = np.full(n + 1, -1, dtype=np.int64)  # the last one is for cells that are empty
        new[kept] = np.arange(len(kept))
        for i in range(0, len(kept), 10_000):  # each row moves to its new place, which is no later
            some = kept[i : i + 10_000]
            rows[i : i + len(some)] = new[rows[some]]
            self.emit[i * self.width : (i + len(some)) * self.width] = self.emit[: n * self.width].reshape(n, self.width)[some].ravel()
        self.next[len(kept) * self.width :] = -1
        self.blind[: len(kept)] = self.blind[kept]
        self.states = [self.states[i] for i in kept.tolist()]
        self.ids = {s: i for i, s in enumerate(self.states)}
        for x in used:
            x[:] = new[x]

    def kinds(self, c: str) -> tuple:
        if c not in self.characters:
            if len(self.characters) > 200_000:
                self.characters.clear()
            split = lambda s: [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(s)]
            out: tuple = ()
            for x in self.library.normalizer.normalize_str(c):
                among, marks = split(f"a{x}a"), split(f"!{x}!")
                kind = "L" if len(among) == 1 else "S" if len(among) == 2 else "P" if len(marks) == 1 else "N"
                out += ((kind, b"" if kind == "S" else x.encode()),)
            self.characters[c] = out
        return self.characters[c]

    def step(self, state: tuple, kind: str, text: bytes) -> tuple[tuple, int]:
        """One character, by the split's rules."""
        mode = state[0]
        if mode == "between":
            if kind == "L" or kind == "P":
                word, n = ((b"", None, 0),), 0
                for b in text:
                    word, more = self.read(word, b)
                    n += more
                return ("'" if text == b"'" else kind, word), n
            return state, {"N": self.count(text) if kind == "N" else 0, "X": 1}.get(kind, 0)
        if mode == kind or mode == "'" and kind == "P" and len(state) == 2:  # behind a held letter the apostrophe stands alone
            word, n = state[1], 0
            for b in text:
                word, more = self.read(word, b)
                n += more
            return (kind, word), n
        if mode == "'" and kind == "L":
            held = (state[2] if len(state) > 2 else b"") + text
            if held in CONTRACTIONS:
                return ("between",), self.count(b"'" + held)
            if any(c.startswith(held) for c in CONTRACTIONS):
                return ("'", state[1], held), 0
        n, behind = self.finish(state[1]), ("between",)
        if len(state) > 2:  # the apostrophe stands alone, and what was held begins a word
            behind, more = self.step(behind, "L", state[2])
            n += more
        behind, more = self.step(behind, kind, text)
        return behind, n + more

    def fill(self, state: int, column: int) -> None:
        """Make the transition."""
        byte = self.bytes[column]
        core, held = self.states[state]
        n, kinds = 0, ()
        if byte == SPECIAL:
            held, kinds = b"", (("X", b""),)
        elif byte < 0x80:
            held, kinds = b"", self.kinds(chr(byte))
        elif byte >= 0xC0 or held:  # else the rest of a character whose beginning lies before what is read
            held = bytes([byte]) if byte >= 0xC0 else held + bytes([byte])
            if len(held) == 2 + (held[0] >= 0xE0) + (held[0] >= 0xF0):
                held, kinds = b"", self.kinds(held.decode())
        if core[0] == "unknown":
            core = ("between",) if kinds and kinds[-1][0] in "SX" else core
        else:
            for kind, text in kinds:
                core, more = self.step(core, kind, text)
                n += more
        to = self.id_of((core, held))
        self.next[state * self.width + column], self.emit[state * self.width + column] = to, n

    def move(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = states * self.width + read
        to = self.next.take(at)
        if to.min(initial=0) < 0:
            for i in np.unique(at[to < 0]).tolist():
                self.fill(*divmod(i, self.width))
            to = self.next.take(at)
        return to, self.emit.take(at)

    # ---- texts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, sizes = [], []
        for text in texts:
            pieces = [text]
            for x in self.special:
                pieces = [y for p in pieces for y in _between(p, x)]
            size = 1
            for x in pieces:
                raw = bytes([SPECIAL]) if x is None else x.encode()
                if x is not None and not x.isascii() and max(raw) >= 0xCC:  # characters from U+0300 on
                    raw = self.nfc(x).encode()
                parts.append(raw)
                size += len(raw)
            parts.append(b" ")
            sizes.append(size)
        if not sizes:
            return np.zeros(0, dtype=np.int64)
        total = sum(sizes)
        raw = np.frombuffer(b"".join(parts) + b" " * (-total % CHUNK), dtype=np.uint8)
        read = self.columns.take(raw)
        if read.min() < 0:
            for byte in np.flatnonzero(np.bincount(raw, minlength=256) * (self.columns < 0)).tolist():
                self.columns[byte] = self.column_of(byte)
            read = self.columns.take(raw)
        emitted = self.scan(np.ascontiguousarray(read.reshape(-1, CHUNK).T))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(emitted.T.ravel()[:total].astype(np.int64), starts)

    def scan(self, read: np.ndarray) -> np.ndarray:
        """Tokens emitted at each place, those of a chunk's part before its first white space at its first place; read: a column per chunk."""
        steps, n = read.shape
        emitted = np.zeros(read.shape, dtype=np.uint16)
        state = np.full(n, UNKNOWN, dtype=np.int64)
        state[0] = BETWEEN
        head = np.full(n, steps - 1, dtype=np.int64)  # the last place that depends on what came in
        unknown = np.arange(1, n)
        for t in range(steps):
            try:
                to, emitted[t] = self.move(state, read[t])
            except Full:
                self.keep(state)
                to, emitted[t] = self.move(state, read[t])
            state = to.astype(np.int64)
            if len(unknown):
                still = self.blind[state[unknown]]
                head[unknown[~still]] = t
                unknown = unknown[still]
        if n > 1:
            through = np.zeros(n, dtype=bool)
            through[unknown] = True
            chunk, count = self.heads(read, state, head, through)
            emitted[0, chunk] += count.astype(np.uint16)
        return emitted

    def walk(self, read: np.ndarray, chunk: np.ndarray, state: np.ndarray, first: int, last: np.ndarray, *used: np.ndarray) -> np.ndarray:
        """From these states (which become those behind) over places first to last of these chunks; the tokens emitted."""
        count, live = np.zeros(len(chunk), dtype=np.int64), np.arange(len(chunk))
        for t in range(first, int(last.max(initial=-1)) + 1):
            live = live[last[live] >= t]
            try:
                to, more = self.move(state[live], read[t, chunk[live]])
            except Full:
                self.keep(state, *used)
                to, more = self.move(state[live], read[t, chunk[live]])
            state[live] = to
            count[live] += more
        return count

    def heads(self, read: np.ndarray, state: np.ndarray, head: np.ndarray, through: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks from the second on, with the tokens of each up to its head."""
        n = len(state)
        steps = len(read)
        after = np.flatnonzero(through[:-1]) + 1  # chunks whose incoming state takes a map
        chunk = np.concatenate([np.flatnonzero(~through[:-1]) + 1, after])
        guess = np.full(len(after), BETWEEN, dtype=np.int64)
        self.walk(read, after - 1, guess, max(0, steps - BEHIND), np.full(len(after), steps - 1), state)
        # nodes: a chunk and a state that may come in, with the state behind and the tokens
        came = np.concatenate([state[chunk[: len(chunk) - len(after)] - 1], guess])
        true = np.arange(len(chunk)) < len(chunk) - len(after)
        gone = came.copy()
        count = self.walk(read, chunk, gone, 0, head[chunk], came)
        for turn in range(n + 1):
            # where each node's map leads
            key = chunk << 32 | came
            order = np.argsort(key)
            want = chunk + 1 << 32 | gone
            at = np.minimum(np.searchsorted(key[order], want), len(key) - 1)
            passes = through[chunk] & (chunk + 1 < n)
            known = passes & (key[order][at] == want)
            leads = np.where(known, order[at], -1)
            reached, jump = true.copy(), leads.copy()
            while (jump >= 0).any():  # spans of composed maps, twice as long each time
                reached[jump[reached & (jump >= 0)]] = True
                jump = np.where(jump >= 0, jump[jump], -1)
            open_ends = passes & ~known & (reached if turn >= ROUNDS else True)
            if not (open_ends & reached).any():
                return chunk[reached], count[reached]
            new = np.unique(want[open_ends])
            to, begin = new >> 32, new & 0xFFFFFFFF
            behind = begin.copy()
            # renumbered together, if there is no room
            old, been = gone, came
            more = self.walk(read, to, behind, 0, head[to], begin, old, been)
            chunk, came, gone = np.concatenate([chunk, to]), np.concatenate([been, begin]), np.concatenate([old, behind])
            count, true = np.concatenate([count, more]), np.concatenate([true, np.zeros(len(to), dtype=bool)])
        raise AssertionError("each turn reaches another chunk")


def _between(text: str | None, special: str) -> list:
    """The stretches of a text around a special string, with None in its places."""
    if text is None or special not in text:
        return [text]
    out: list = []
    for x in text.split(special):
        out += [x, None]
    return out[:-1]


def transducer(path: str) -> Transducer:
    """This worker's compilation of a file, kept from task to task."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each text.

    Null text counts as empty: 0 bytes, 0 tokens. Each row is counted by itself, repeated or not; no shuffle is needed.
    """
    share_code(docs.sparkSession)

    def run(batches):
        machine = transducer(tokenizer)
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for begin, stop in in_parts(texts):
                part = texts[begin:stop]
                n = machine.counts(part)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, stop - begin), pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return spread(docs.select("doc_id", "text"), "doc_id", per_core=1).mapInArrow(run, SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
