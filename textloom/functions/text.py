"""Text kernels as column expressions. Classes are spelled out, so that every engine reads them alike."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alphanumeric but no decimal digit; digits; the rest that is no white space.
LETTER, DIGIT, OTHER = r"[\p{L}\p{Nl}\p{No}]", r"\p{Nd}", r"[^\p{L}\p{N}\s’]"
#: Word, number or punctuation with the space before it, newlines, indentation but its last space, a space.
CHUNK = rf" ?[\p{{L}}\p{{Nl}}\p{{No}}’]+| ?{DIGIT}+| ?{OTHER}+|\n+| +(?= )| "
#: A line of no lower-case a-z with a capital, that ends in a full stop; bracketed directions; the beginnings of headings and of
#: entrances: fixed values.
LABEL = r"^[^a-z]*[A-Z][^a-z]*\.$"
DIRECTION = r"(?s)\[_.*?_\.?\]"
HEADING = r"^(ACT |SCENE |PROLOGUE|EPILOGUE|INDUCTION|Dramatis Person|THE PROLOGUE|THE EPILOGUE)"
#: The first of these ends the title page and the cast.
BODY = r"^(ACT |SCENE |PROLOGUE|INDUCTION|THE PROLOGUE)"
ENTRANCE = r"^(Enter |Exeunt|Exit |Re-enter |Alarum|Flourish|Sennet|Manet|They fight|Music|Drum|Trumpet|A march|March|Retreat|Shout|Hautboys|Cornets|Thunder|Storm|Sound|Horns|Knock)"
#: Characters a text cut into windows at once holds: substring() walks from the start.
BLOCK = 256


def chunks(text: Column | str) -> Column:
    """The chunks of a text; an error if they don't cover it (a tab, for example)."""
    found = F.regexp_extract_all(text, F.lit(CHUNK), 0)
    whole = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x)) == F.length(text)
    return F.when(whole, found).otherwise(F.raise_error(F.lit("text holds a character that the chunk rule does not cover")))


def plain(text: Column | str) -> Column:
    """Layout-free: lower case, curly apostrophes gone, everything but letters one space."""
    bare = F.translate(F.lower(text), "’‘", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}]+", " "))


def characters(df: DataFrame, *keep: str) -> DataFrame:
    """keep, pos (from 0), ch."""
    return df.select(*keep, F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")


def windows(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """Every run of `width` characters: keep, pos (from 0), piece. Texts are first cut into blocks that overlap."""
    n = F.length("text")
    blocks = df.where(n >= width).select(*keep, "text", F.explode(F.sequence(F.lit(0), n - width, F.lit(BLOCK))).alias("begin"))
    blocks = blocks.select(*keep, "begin", F.substring("text", F.col("begin") + 1, F.lit(BLOCK + width - 1)).alias("block"))
    cut = F.transform(F.sequence(F.lit(1), F.length("block") - (width - 1)), lambda i: F.substring(F.col("block"), i, F.lit(width)))
    return blocks.select(*keep, "begin", F.posexplode(cut).alias("at", "piece")).select(*keep, (F.col("begin") + F.col("at")).alias("pos"), "piece")


#: What a prompt's characters become: fixed values.
INSTEAD = {
    "'": "’", "\u02bc": "’", "\u2032": "’", "\u00b4": "’", "`": "’",
    "\t": " ", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u2009": " ", "\u2002": " ", "\u2003": " ",
    "\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x85": "\n", "\u2028": "\n", "\u2029": "\n",
    "\u2013": "—", "\u2012": "—", "\u2015": "—", "\u2212": "-",
    "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "", "\u00ad": "",
}
#: A straight double quote behind one of these opens: fixed values.
OPENS_AFTER = frozenset(" \n([{-—")


def described(c: str) -> str:
    """A character for a note: shown if there is something to see, then by Unicode's name and number."""
    about = ", ".join(x for x in (unicodedata.name(c, "").lower(), f"U+{ord(c):04X}") if x)
    return f"{c} ({about})" if c.isprintable() and not c.isspace() else about


def normalised(prompt: str, alphabet: frozenset[str]) -> tuple[str, list[str]]:
    """A prompt in the alphabet's characters, and what was changed in it. Refuses (ValueError) what has no stand-in, and an empty one.

    The alphabet is asked first. Then a table of stand-ins; then a straight double quote opens at the start and behind what
    OPENS_AFTER holds, and closes elsewhere (behind what became nothing, too). Spaces at the end go.
    """
    given = unicodedata.normalize("NFC", prompt.replace("\r\n", "\n"))
    for c in dict.fromkeys(given):
        if c not in alphabet and c not in INSTEAD and c != '"':
            near = "".join(x for x in unicodedata.normalize("NFD", c) if x in alphabet)
            raise ValueError(f"{described(c)} is not in the alphabet" + (f"; the nearest letter there is {near!r}" if near else ""))
    spelled = [c if c in alphabet else INSTEAD.get(c, c) for c in given]
    straight = [i for i, c in enumerate(given) if c == '"' and c not in alphabet]
    for i in straight:
        spelled[i] = "“" if i == 0 or spelled[i - 1] in OPENS_AFTER else "”"
    notes = [f"{described(a)} -> {described(b)}" if b else f"{described(a)} left out" for a, b in zip(given, spelled) if a not in alphabet]
    text = "".join(spelled)
    bare = text.rstrip(" ")
    if len(bare) < len(text):
        notes.append(f"cut off at the end: {len(text) - len(bare)} x U+0020")
    if not bare:
        raise ValueError("an empty prompt")
    return bare, notes
