"""Plain forms of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


def near(rows, size, percent=80):
    """Component of every row number: the smallest row number reachable."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(rows))], sets


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {k + d for v in places.values() if len(v) > 1 for k in v for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_capitals": len(re.findall("[A-Z]", t)),
    }


def base_failed(m):
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


def rules(rows, least, spread, group_rows, two_sided):
    """kept per (text, lang, source) row, with exact quantiles."""
    got = [measures(t) for t, _, _ in rows]

    def ratios(m):
        n = m["n_words"]
        return {
            "symbols": m["n_symbols"] / n,
            "capitals": m["n_capitals"] / m["word_chars"],
            "repeats": m["n_repeat_words"] / n,
            "dup_lines": m["n_dup_lines"] / m["n_lines"],
            "word_length": m["word_chars"] / n,
        }

    groups = defaultdict(list)
    for m, (_, lang, source) in zip(got, rows, strict=True):
        if not base_failed(m):
            for level in ((lang, source), (lang,), ()):
                groups[level].append(ratios(m))

    def fence(level, x):
        v = sorted(r[x] for r in groups[level])
        low, high = (v[int(np.ceil(q * len(v))) - 1] for q in (0.25, 0.75))
        reach = max(high - low, least[x]) * spread
        return low - reach, high + reach

    out = []
    for m, (_, lang, source) in zip(got, rows, strict=True):
        if base_failed(m):
            out.append(False)
            continue
        level = next(g for g in ((lang, source), (lang,), ()) if not g or len(groups[g]) >= group_rows)
        r = ratios(m)
        out.append(all(r[x] <= fence(level, x)[1] and (x not in two_sided or r[x] >= fence(level, x)[0]) for x in least))
    return out


def boilerplate(rows, min_sites, share):
    """Lines (trimmed) of (text, site) rows that reach both thresholds."""
    sites, contexts, n = defaultdict(set), defaultdict(set), Counter()
    for text, site in rows:
        lines = [x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")]
        seen = set()
        for i, x in enumerate(lines):
            around = (lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else "")
            if x:
                sites[x].add(site)
                contexts[x].add(around)
                n[x] += 1
            seen.add(x)
    return {x for x in n if len(sites[x]) >= min_sites and len(contexts[x]) >= max(n[x] * share, 2)}


def without(text, bad):
    if text is None:
        return None
    return "\n".join(x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c") not in bad)


def leaks(docs, items, percent=80):
    """{(doc number, item): similarity} of the best window of every start."""

    def grams(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    split = [(i, (t or "").lower().split()) for i, t in items]
    index = defaultdict(set)
    for i, w in split:
        for s in grams(w):
            index[s].add(i)
    by = dict(split)
    out = {}
    for d, t in enumerate(docs):
        w = (t or "").lower().split()
        hits = defaultdict(list)
        for p, s in enumerate(grams(w)):
            for i in index.get(s, ()):
                hits[i].append(p)
        for i, places in hits.items():
            size, want = len(by[i]), Counter(grams(by[i]))
            starts = {q for p in places for q in range(max(0, p - size), p + 1)}
            best = max(sum((c & want).values()) / sum((c | want).values()) for c in (Counter(grams(w[q : q + size])) for q in starts))
            if best * 100 >= percent:
                out[d, i] = best
    return out
