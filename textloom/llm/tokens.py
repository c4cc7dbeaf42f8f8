"""Ids of a tokenizer file, as the tokenizers library gives them, at several times its speed.

Where a file's ids are the ranks of its merges, the merges run in tiktoken, from the file's own vocabulary; a file whose
words end in a suffix gets one byte in the suffix's place. The tokenizers library itself encodes texts that hold a special
string, very long white space, or characters outside PLAIN (where normal forms and character classes may differ between
libraries), and all texts of other files. Tests hold both ways equal, character by character.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import cached_property

import numpy as np
import regex

#: Characters on which NFC does nothing and the pattern classes of both libraries agree (a test goes through them all).
PLAIN = r"\x00-\x1b -˿Ѐ-ҁҊ-ԯ‐-‧‰-⁞₠-₿、-〩ぁ-ゖァ-ヺ一-龿가-힣"
#: White space of the tokenizers library (Unicode's White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
#: The split of byte-level tokenizers, with white space spelled out.
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Byte-level alphabets write printable bytes as they are and the others as the characters from 256 on.
BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: What ends a word in a text whose words are marked, and stands for the suffix.
END = "\x00"
#: A run of so much white space goes to the tokenizers library: tiktoken's look-ahead behind it takes stack for each character.
GAP = 100_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """encode(texts) gives the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        steps = pre.get("pretokenizers", [])
        suffix = model.get("end_of_word_suffix") or ""
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.unlike = regex.compile(f"[^{PLAIN}]").search
        self.runs = regex.compile(f"[{SPACE}]{{64,}}+").finditer  # a count of GAP would be compiled to tens of MB
        self.fast = None
        if model["type"] != "BPE" or not _ranked(model["vocab"], model["merges"]):
            return
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm and not suffix:
            self.fast = _ranks(model["vocab"], "", BYTE_LEVEL).encode_ordinary
        elif [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and suffix:
            self.words = regex.compile(steps[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}")).findall
            run = _ranks(model["vocab"], suffix, rf"[^{END}]+{END}").encode_ordinary
            self.fast = lambda text: run(self.marked(text))
            self.special.append(END)

    @cached_property
    def library(self):
        """Tens of MB of a worker, so made when a text first needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def marked(self, text: str) -> str:
        """The words of a text, each with END behind it."""
        words = [w if w.isalpha() else END.join(self.words(w)) for w in text.lower().split()]
        return END.join(words) + END if words else ""

    def odd(self, text: str) -> bool:
        if any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # those four are white space to Python alone
            return True
        if len(text) > GAP and any(x.end() - x.start() >= GAP for x in self.runs(text)):
            return True
        return not text.isascii() and np.frombuffer(text.encode("utf-32-le"), "<u4").max() >= 0x300 and bool(self.unlike(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.library.encode(t, add_special_tokens=False).ids if self.fast is None or self.odd(t) else self.fast(t)).tobytes() for t in texts]


def _ranked(vocab: dict[str, int], merges: list) -> bool:
    """Whether ids follow the order of the merges, from the single symbols on."""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    first = len(vocab) - len(pairs)
    return all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(pairs))


def _ranks(vocab: dict[str, int], suffix: str, pattern: str):
    import tiktoken

    byte = {BYTES.get(b, chr(b)): b for b in range(256)}

    def plain(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return bytes(byte[c] for c in (token[: -len(suffix)] if ends else token)) + END.encode() * ends

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={plain(t): i for t, i in vocab.items()}, special_tokens={})


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def in_parts(texts: list, size: int = 2_000_000):
    """Consecutive runs (begin, end) of about `size` characters at most, so that memory does not follow the batch."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
