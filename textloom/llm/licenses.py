"""License detection by ordered signature rules.

Rules are regular expressions over a text's words: sentences of the licenses' own texts (license_texts.py) and of their usual notices, written one by one,
and, for each license of a table, its SPDX tag, a grant that names it, its name with and without a version, and its address. A rule
has a priority, a label, a keyword and an expression; where the expression finds a version, a number of clauses or "or later", the label
carries it (gpl-3.0-or-later, bsd-3-clause). An Aho-Corasick automaton finds which keywords a text holds; only the rules of those are
run. Detections are taken in order of priority, then length, then place, and one that lies inside a taken detection, of whatever label,
is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import share_code, spread, table
from .license_texts import BODIES

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, names as words (a name may be a pattern), SPDX identifiers as words, and words of its address.
LICENSES = [
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl"], ["agpl"], ["gnu org licenses agpl"]),
    ("lgpl", ["gnu lesser general public license", "lesser general public license", "gnu library general public license", "gnu lgpl"], ["lgpl"], ["gnu org licenses lgpl"]),
    ("gfdl", ["gnu free documentation license", "free documentation license"], ["gfdl"], ["gnu org licenses fdl"]),
    ("gpl", ["gnu general public license", "gnu gpl"], ["gpl"], ["gnu org licenses gpl"]),
    ("apache", ["apache software license", "apache license version"], ["apache"], ["apache org licenses license"]),
    ("mit", ["the mit license", "expat license", "mit expat license"], ["mit"], ["opensource org licenses mit"]),
    ("bsd", ["(?P<clause>2|two|3|three|4|four) clause bsd license", "(?P<clause>simplified|new|modified|revised|original) bsd license", "bsd license", "berkeley software distribution license"], ["bsd"], ["opensource org licenses bsd"]),
    ("isc", ["isc license", "internet systems consortium license"], ["isc"], ["opensource org licenses isc"]),
    ("mpl", ["mozilla public license"], ["mpl"], ["mozilla org mpl"]),
    ("epl", ["eclipse public license"], ["epl"], ["eclipse org legal epl"]),
    ("eupl", ["european union public licen[cs]e"], ["eupl"], ["joinup ec europa eu"]),
    ("cddl", ["common development and distribution license"], ["cddl"], ["opensource org licenses cddl"]),
    ("cpl", ["common public license"], ["cpl"], ["opensource org licenses cpl"]),
    ("artistic", ["artistic license", "perl artistic license"], ["artistic"], ["opensource org licenses artistic"]),
    ("boost", ["boost software license"], ["bsl"], ["boost org license"]),
    ("zlib", ["zlib license", "zlib libpng license"], ["zlib"], ["zlib net zlib license"]),
    ("unlicense", ["the unlicense", "released into the public domain"], ["unlicense"], ["unlicense org"]),
    ("wtfpl", ["do what the fuck you want to public license"], ["wtfpl"], ["wtfpl net"]),
    ("python", ["python software foundation license", "psf license agreement"], ["psf", "python"], ["python org psf license"]),
    ("ruby", ["ruby license"], ["ruby"], ["ruby lang org en about license"]),
    ("php", ["php license"], ["php"], ["php net license"]),
    ("ofl", ["sil open font license", "open font license"], ["ofl"], ["scripts sil org ofl"]),
    ("osl", ["open software license"], ["osl"], ["opensource org licenses osl"]),
    ("afl", ["academic free license"], ["afl"], ["opensource org licenses afl"]),
    ("ms-pl", ["microsoft public license"], ["ms pl"], ["opensource org licenses ms pl"]),
    ("ms-rl", ["microsoft reciprocal license"], ["ms rl"], ["opensource org licenses ms rl"]),
    ("odbl", ["open database license", "open data commons open database license"], ["odbl"], ["opendatacommons org licenses odbl"]),
    ("cc-by-nc-sa", ["creative commons attribution non ?commercial share ?alike"], ["cc by nc sa"], ["creativecommons org licenses by nc sa"]),
    ("cc-by-nc-nd", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"], ["cc by nc nd"], ["creativecommons org licenses by nc nd"]),
    ("cc-by-sa", ["creative commons attribution share ?alike"], ["cc by sa"], ["creativecommons org licenses by sa"]),
    ("cc-by-nd", ["creative commons attribution no ?deriv(?:ative)?s(?: works)?"], ["cc by nd"], ["creativecommons org licenses by nd"]),
    ("cc-by-nc", ["creative commons attribution non ?commercial"], ["cc by nc"], ["creativecommons org licenses by nc"]),
    ("cc-by", ["creative commons attribution"], ["cc by"], ["creativecommons org licenses by"]),
    ("cc0", ["creative commons zero", "cc0 1 0 universal"], ["cc0"], ["creativecommons org publicdomain zero"]),
    ("openssl", ["openssl license", "openssl toolkit license"], ["openssl"], ["openssl org source license"]),
    ("postgresql", ["postgresql license"], ["postgresql"], ["postgresql org about licence"]),
    ("upl", ["universal permissive license"], ["upl"], ["opensource org licenses upl"]),
    ("ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], ["ncsa"], ["opensource org licenses ncsa"]),
    ("sspl", ["server side public license"], ["sspl"], ["mongodb com licensing server side public license"]),
    ("busl", ["business source license"], ["busl"], ["mariadb com bsl"]),
    ("qpl", ["q public license"], ["qpl"], ["opensource org licenses qpl"]),
    ("cecill", ["cecill free software license(?: agreement)?", "cecill license"], ["cecill"], ["cecill info licences"]),
    ("mulan", ["mulan permissive software license"], ["mulanpsl"], ["license coscl org cn mulanpsl"]),
    ("vim", ["vim license"], ["vim"], ["vimhelp org uganda"]),
    ("beerware", ["beer ?ware license"], ["beerware"], []),
    ("json", ["json license", "software shall be used for good not evil"], ["json"], ["json org license"]),
    ("proprietary", ["all rights reserved", "proprietary and confidential", "unauthorized copying of this file"], [], []),
]
#: Label, keyword and expression of sentences that name a license without its name, or tell its versions apart. The first come first.
SIGNATURES = [
    ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?! and (?:accompanying|associated))"),
    ("mit", "copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("x11", "shall not be used in advertising or otherwise", r"except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("0bsd", "with or without fee is hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "with or without fee is hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?"),
    ("isc", "with or without fee is hereby granted", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", "without fee is hereby granted provided", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted provided that"),
    ("postgresql", "without a written agreement is hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd-4-clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "be used to endorse or promote products", r"neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-1.1", "acknowledgment this product includes software developed by the apache", r"acknowledgment this product includes software developed by the apache software foundation"),
    ("apache-2.0", "in compliance with the license", r"licensed under the apache license version 2 0 the license you may not use (?:this file|this work|these files) except in compliance with the license"),
    ("apache", "distributed under the license is distributed", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "to the apache software foundation", r"licensed to the apache software foundation (?:asf )?under one or more contributor license agreements"),
    ("gpl", "this program is free software", r"this program is free software (?:you can redistribute it and or modify it|and is licensed) under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either)?(?P<v> version \d(?: \d)?)?(?: of the license)?(?P<later> or at your option any later version| or later)?"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general", r"you (?:can|may) redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either)?(?P<v> version \d(?: \d)?)?(?: of the license)?(?P<later> or at your option any later version| or later)?"),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)?(?P<v> version \d(?: \d)?)?(?: of the license)?(?P<later> or at your option any later version| or later)?"),
    ("agpl", "terms of the gnu affero general public license", r"(?:redistribute it and or modify it )?under the terms of the gnu affero general public license(?: as published by the free software foundation)?(?: either)?(?P<v> version \d(?: \d)?)?(?: of the license)?(?P<later> or at your option any later version| or later)?"),
    ("gpl", "a copy of the gnu general public license", r"you should have received a copy of the gnu general public license(?P<v> version \d(?: \d)?)? along with this (?:program|software|package)"),
    ("lgpl", "a copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license(?P<v> version \d(?: \d)?)? along with this (?:program|software|library)"),
    ("agpl", "a copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license(?P<v> version \d(?: \d)?)? along with this (?:program|software)"),
    ("agpl", "interacting with it remotely through a computer network", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gpl", "in the hope that it will be useful", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "in the hope that it will be useful", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("mpl-2.0", "a copy of the mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "this source code form is subject to the terms", r"this source code form is subject to the terms of the mozilla public license(?: v(?:ersion)?)?(?P<v> ?\d(?: \d)?)?"),
    ("mpl", "the contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public license(?P<v> version \d(?: \d)?)?"),
    ("cddl", "subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", "this program and the accompanying materials", r"this program and the accompanying materials are (?:licensed and )?made available under the terms of the eclipse public license(?: v(?:ersion)?)?(?P<v> ?\d(?: \d)?)?"),
    ("epl-2.0", "secondary license", r"this source code may also be made available under the following secondary licenses when the conditions"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?P<v>(?: version)? \d(?: \d)?)?(?P<later> or as soon they will be approved)?"),
    ("boost-1.0", "boost software license version", r"distributed under the boost software license version 1 0 see accompanying file"),
    ("boost", "a copy of the software and accompanying documentation", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "without any express or implied warranty in no event", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "free and unencumbered software released", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "just do what the fuck you want to public license", r"you just do what the fuck you want to public license"),
    ("beerware", "whatever you want with this stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "shall be used for good not evil", r"the software shall be used for good not evil"),
    ("python", "psf hereby grants licensee", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "software developed by the openssl project", r"this product includes software developed by the openssl project"),
    ("php", "includes php software", r"this product includes php software freely available from"),
    ("ofl", "this font software is licensed", r"this font software is licensed under the sil open font license(?: version)?(?P<v> \d \d)?"),
    ("artistic", "state the conditions under which a package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "same terms as perl itself", r"(?:you can redistribute it and or modify it )?under the same terms as perl itself"),
    ("cc0", "waived all copyright and related", r"to the extent possible under law (?:[^ ]+ ){1,12}ha(?:s|ve) waived all copyright and related or neighboring rights"),
    ("cc-by", "you must give appropriate credit provide a link", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "your contributions under the same license", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "use the material for commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "may not distribute the modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("ms-pl", "if you use the software you accept this license", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("upl", "subject to the condition set forth below", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("ncsa", "with the software without restriction", r"to deal with the software without restriction including without limitation the rights to use copy modify merge"),
    ("sspl", "make the functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", "licensor hereby grants you the right to copy", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("public-domain", "the public domain", r"(?:this|the) (?:work|code|file|software|program|library) (?:is|has been) (?:hereby )?(?:placed |released |dedicated )?in(?:to)? the public domain"),
    ("public-domain", "to the public domain", r"(?:i|we|the authors?) (?:hereby )?(?:dedicate|release)s? (?:this|the) (?:work|code|file|software|program|library) to the public domain"),
    ("proprietary", "confidential and proprietary", r"(?:this (?:software|document|file) is|contains) (?:the )?confidential and proprietary (?:information|property)"),
    ("proprietary", "unauthorized copying of this", r"unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("proprietary", "without the prior written", r"may not be (?:copied|reproduced|distributed|disclosed)(?: [^ ]+){0,10} without the prior written (?:permission|consent)"),
    ("proprietary", "not for redistribution", r"internal use only not for redistribution"),
]
#: A version behind a name, and what a grant says of later ones.
VERSION = r"(?P<v>(?: (?:version|v))? ?v?\d(?: \d{1,2}){0,2})(?P<later> or (?:at your option )?any later version| or (?:at your option )?later| or newer| plus)?(?P<only> only)?"
#: Forms of a name and how sure they are; {n} is the name. Earlier forms have priority over later ones.
FORMS = [
    (1.0, r"(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?{n}(?:" + VERSION + ")?"),
    (0.95, r"{n}" + VERSION),
    (0.9, r"(?:subject to|under the terms of|according to|governed by|in accordance with) (?:the )?{n}"),
    (0.85, r"{n}s? (?:applies|agreement|text|file|header|notice)"),
    (0.8, r"{n}"),
]
CLAUSES = {"two": "2", "three": "3", "four": "4", "simplified": "2", "new": "3", "modified": "3", "revised": "3", "original": "4"}


def _rules() -> list[tuple[int, str, float, str, re.Pattern]]:
    """(priority, label, score, keyword, pattern), the most specific first."""
    raw: list[tuple[str, float, str, str]] = [(label, 1.0, key, p) for label, key, p in SIGNATURES]
    raw += [(label, 1.0, _literal(p), p) for label, p in BODIES]
    for label, _, tags, _ in LICENSES:
        raw += [(label, 1.0, "spdx license identifier " + t, rf"spdx license identifier {t}(?P<v>(?: \d+)+)?(?P<clauses> clause)?(?P<only> only)?(?P<later> or later| plus)?") for t in tags]
    for sure, form in FORMS:
        for label, names, _, _ in LICENSES:
            raw += [(label, sure, _keyword(n), form.replace("{n}", n)) for n in names]
    for label, _, _, places in LICENSES:
        raw += [(label, 0.9, p, rf"(?:https? )?(?:www )?{p}(?P<v>(?: \d+)+)?") for p in places]
    for phrase, label in BASE.items():
        raw.append((label, 0.7, phrase, phrase))
    return [(i, label, sure, key, re.compile(rf"(?<![^ ])(?:{p})(?![^ ])")) for i, (label, sure, key, p) in enumerate(raw)]


def labelled(label: str, found: re.Match) -> str:
    """The label, with the version, clauses and later versions that the match tells."""
    told = found.groupdict()
    numbers = re.findall(r"\d+", told.get("v") or "")
    clause = told.get("clause")
    if clause or told.get("clauses"):
        return f"{label}-{CLAUSES.get(clause, clause) if clause else (numbers or ['3'])[0]}-clause"
    if not numbers:
        return label
    version = ".".join(numbers if len(numbers) > 1 else [*numbers, "0"])
    return f"{label}-{version}" + ("-or-later" if told.get("later") else "-only" if told.get("only") else "")


def _keyword(pattern: str) -> str:
    """The longest stretch of a name that stands as it is."""
    return max(re.split(r" \?|\((?:\?:|\?P<\w+>)[^()]*\)\??|\[[^]]*\]", pattern), key=len).strip(" ()?") if re.search(r"[\[(?]", pattern) else pattern


def _literal(pattern: str) -> str:
    """The longest stretch of an expression that each match holds: outside of groups and classes, without a letter that may be missing."""
    found, depth, inside = [""], 0, False
    for c in pattern:
        if inside or c == "[":
            inside = c != "]"
            found.append("")
        elif c in "()":
            depth += 1 if c == "(" else -1
            found.append("")
        elif depth or c in "{}+*,|" or found[-1].startswith("{"):
            found.append("{" if c in "{," or c.isdigit() and found[-1].startswith("{") else "")
        elif c == "?":
            found[-1] = found[-1][:-1]
            found.append("")
        else:
            found[-1] += c
    return max((x for x in found if not x.startswith("{")), key=len).strip()


RULES = _rules()
#: Lower case for A-Z, and a space for what is not in a word: a word is of digits, letters and bytes beyond ASCII.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_automaton: list = []


def _keywords():
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        held: dict[str, list[int]] = {}
        for i, rule in enumerate(RULES):
            held.setdefault(rule[3], []).append(i)
        for k, rules in held.items():
            a.add_word(k, rules)
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (rule, begin, end), those that stay: none lies inside one that comes before it by priority, length and place."""
    kept: list[tuple[int, int, int]] = []
    begins: list[int] = []
    furthest: list[int] = []  # of the kept up to here, the furthest end: begins and ends both rise
    for rule, b, e in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
        at = bisect_right(begins, b)
        if at and furthest[at - 1] >= e:
            continue
        kept.append((rule, b, e))
        upto = at
        while upto < len(begins) and furthest[upto] <= e:
            upto += 1
        begins[at:upto], furthest[at:upto] = [b], [e]
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def scan(text: bytes) -> tuple[int, list[int], list[tuple[str, int, int, float]]]:
    """Words of a text, the starts of base phrases with their labels, and detections as (label, first word, last word, score)."""
    words = text.translate(WORDS).split()
    joined = b" ".join(words)
    chars = joined.decode("utf-8", "surrogateescape")
    hits = {i for _, rules in _keywords().iter(chars) for i in rules}
    if not hits:
        return len(words), [], []
    spaces = [m.start() for m in re.finditer(" ", chars)]
    word = lambda at: bisect_right(spaces, at)
    base = [(word(m.start()), label) for phrase, label in BASE.items() if phrase in chars for m in re.finditer(rf"(?<![^ ])(?={phrase}(?![^ ]))", chars)]
    found = {(i, m.start(), m.end()): m for i in sorted(hits) for m in RULES[i][4].finditer(chars)}
    return len(words), base, [(labelled(RULES[i][1], found[i, b, e]), word(b), word(e - 1), RULES[i][2]) for i, b, e in resolve(list(found))]


def detect(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, spans as array of (label, first_word, last_word, score), and base places as array of (word, label).

    Null text has no words. Rows are scanned one by one, repeated or not.
    """
    share_code(docs.sparkSession)
    spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
    places = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))

    def run(batches):
        for b in batches:
            rows = [scan(t.as_py() or b"") for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"word": w, "label": x} for w, x in r[1]] for r in rows], places), pa.array([[{"label": x, "first_word": f, "last_word": t, "score": s} for x, f, t, s in r[2]] for r in rows], spans)], names=["doc_id", "n_words", "base", "spans"])

    schema = "doc_id long, n_words long, base array<struct<word: long, label: string>>, spans array<struct<label: string, first_word: long, last_word: long, score: double>>"
    return spread(docs.select("doc_id", "text"), "doc_id", per_core=1).mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is that of the surest detection, 0 without any."""
    found = detect(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(base) as long) AS n_base", "array_min(base.word) AS first_word", "array_max(base.word) AS last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') AS base_labels",
        "array_join(array_sort(array_union(base.label, spans.label)), ',') AS labels",
        "coalesce(array_max(spans.score), 0D) AS score", "spans",
    )
