"""Plain versions of the operators, and rows that are hard on all of them."""

from __future__ import annotations

import re

import xxhash

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LONG = " ".join(f"w{i % 977} thé{i % 31}," for i in range(40_000))
NASTY = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, "s", 3),
    (4, "one", "fr", None, 3),
    (5, "two words", "fr", "s", None),
    (6, "The MIT License applies. mit license; Apache License, GNU General Public License v3 or later.", "en", "s", 1),
    (7, LONG, "en", "s", len(LONG)),
    (8, "same text again and again", "en", "s", 1),
    (9, "same text again and again", "en", "s", 1),
    (10, "same text again and again", "de", "s", 1),
    (10, "same text again and again", "de", "s", 1),
    (None, "a row without an id", "en", "s", 1),
    (11, "x" * 70_000, None, None, 1),
    (12, "don't <|endoftext|> İstanbul ñandú 日本語 ẞ 𝔘 é \x00 \x1c…", "es", "s", 1),
    (13, "12 345 6,7 !!! '' 's", "en", "s", 1),
]
#: The names that operators use, to clash with theirs.
EXTRA = ["key", "fp", "words", "i", "p", "slot", "start", "length", "part", "held_out", "root", "component_id", "n_tokens", "uid", "base", "spans", "lang_pred", "count", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def nasty(spark):
    df = spark.createDataFrame(NASTY, SCHEMA)
    return df.selectExpr("*", *[f"'clash' AS `{x}`" for x in EXTRA])


def write_tables(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Of (doc_id, fingerprint) rows: the smallest doc_id reachable, per row."""
    kinds = sorted({f for _, f in prints})
    group = {f: f for f in kinds}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                group[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in prints]


def hits(text, items):
    """n_words, n_hit and the ids of items with an occurring window."""
    words = WORD.findall((text or "").encode().lower())
    places = {}
    for i in range(len(words)):
        for n in range(1, 11):
            if i + n <= len(words):
                places.setdefault(tuple(words[i : i + n]), []).append(i)
    hit, found = set(), set()
    for item, t in items:
        own = WORD.findall((t or "").encode().lower())
        n = min(10, len(own))
        for j in range(len(own) - n + 1 if n else 0):
            for i in places.get(tuple(own[j : j + n]), []):
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def licenses(text):
    words = WORD.findall((text or "").encode().lower())
    phrases = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def similar(texts, words=5, least=0.8):
    """Of texts by id: the smallest id reachable over pairs of shingle sets of that similarity, for texts with words."""
    sets, posted = {}, {}
    for d, t in texts.items():
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
        if w:
            sets[d] = {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for d in sorted(sets):
        common = {}
        for s in sets[d]:
            for other in posted.setdefault(s, []):
                common[other] = common.get(other, 0) + 1
            posted[s].append(d)
        for other, n in common.items():
            if n >= least * (len(sets[d]) + len(sets[other]) - n) and (a := root(d)) != (b := root(other)):
                group[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def hmm_scores(texts, held, begin, states, own, shared, shared_class, add, rounds):
    """log10 probability of each text, word by word: classes, Baum-Welch and the recursion in plain loops. begin gives (start, move, emit)."""
    from collections import Counter
    from math import log10

    words = [(t or "").encode().lower().split() for t in texts]
    train = [w for w, h in zip(words, held) if not h]
    n = Counter(x for w in train for x in w)
    levels = sorted(set(n.values()), reverse=True)
    least = 1 << 62
    for level in levels:
        if sum(v >= level for v in n.values()) > own:
            break
        least = level
    ranked = sorted((w for w in n if n[w] >= least), key=lambda w: (-n[w], w))
    number = {w: i for i, w in enumerate(ranked)}
    rest = [[w for w in n if w not in number and shared_class(w) == c] for c in range(shared)]
    smooth = [sum(n[w] for w in r) + add * (len(r) + 1) for r in rest]
    end = len(ranked) + shared
    frequency = [n[w] for w in ranked] + [sum(n[w] for w in r) for r in rest] + [len(train)]
    cls = lambda w: number.get(w, len(ranked) + shared_class(w))
    share = lambda w: 1.0 if w in number else (n[w] + add) / smooth[shared_class(w)]
    start, move, emit = ([*map(float, x)] if i == 0 else [[*map(float, y)] for y in x] for i, x in enumerate(begin(frequency)))

    def forward(seq):
        a, scales = [], []
        for t, c in enumerate(seq):
            now = [(start[s] if t == 0 else sum(a[-1][r] * move[r][s] for r in range(states))) * emit[c][s] for s in range(states)]
            scales.append(sum(now))
            a.append([x / scales[-1] for x in now])
        return a, scales

    for _ in range(rounds):
        es, em, ee = [0.1] * states, [[0.1] * states for _ in range(states)], [[0.01] * states for _ in emit]
        for w in train:
            seq = [*map(cls, w), end]
            a, scales = forward(seq)
            b = [1.0] * states
            for t in range(len(seq) - 1, -1, -1):
                for s in range(states):
                    ee[seq[t]][s] += a[t][s] * b[s]
                    if t == 0:
                        es[s] += a[0][s] * b[s]
                if t:
                    ahead = [emit[seq[t]][s] * b[s] / scales[t] for s in range(states)]
                    for r in range(states):
                        for s in range(states):
                            em[r][s] += a[t - 1][r] * move[r][s] * ahead[s]
                    b = [sum(move[r][s] * ahead[s] for s in range(states)) for r in range(states)]
        start = [x / sum(es) for x in es]
        move = [[x / sum(r) for x in r] for r in em]
        totals = [sum(r[s] for r in ee) for s in range(states)]
        emit = [[r[s] / totals[s] for s in range(states)] for r in ee]
    return [sum(log10(x) for x in forward([*map(cls, w), end])[1]) + sum(log10(share(x)) for x in w) for w in words]


def kneser_ney(texts, order, alphabet):
    """prob(context, c) of an interpolated model with one discount an order, from counts in dictionaries. texts: normalised, with their padding."""
    from collections import Counter

    levels = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):  # how many different characters stand before
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount = {}
    for n, counts in levels.items():
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5

    def prob(context, c, n):
        if n == 0:
            return 1 / alphabet
        own = context[len(context) - n + 1 :] if n > 1 else ""
        behind = {g: v for g, v in levels[n].items() if g[:-1] == own}
        lower = prob(context, c, n - 1)
        if not behind:
            return lower
        total = sum(behind.values())
        return max(behind.get(own + c, 0) - discount[n], 0) / total + discount[n] * len(behind) / total * lower

    return lambda context, c: prob(context, c, order)
