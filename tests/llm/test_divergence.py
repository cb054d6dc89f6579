"""Transducers and the source audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linescope.llm import divergence, transducer

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs=3, top=200):
    docs = [((r["lang"] or ""), (r["source"] or ""), TERM.findall((r["text"] or "").translate(LOW))) for r in rows]
    seen, groups = Counter(), defaultdict(Counter)
    for lang, source, terms in docs:
        seen.update({(lang, t) for t in terms})
        groups[lang, source].update(terms)
    kept = defaultdict(list)
    for (lang, t), n in seen.items():
        if n >= min_docs:
            kept[lang].append(t)

    def shares(counts, terms):
        total = sum(counts[t] for t in terms) + len(terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // total for t in terms}

    out = set()
    for (lang, source), counts in groups.items():
        terms = kept[lang]
        p = shares(counts, terms)
        pairs = []
        for (other_lang, other), theirs in groups.items():
            if other_lang == lang and other != source:
                q = shares(theirs, terms)
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in terms), other.encode(), other))
        q = shares(sum((c for (g, _), c in groups.items() if g == lang), Counter()), terms)
        stands = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in terms if counts[t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(stands)[:top])):
            out |= {(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    """Sources that are alone, empty, null or full of ties; one text of many terms; clashing columns."""
    rng, rows = random.Random(2), []
    words = ["alpha", "Beta", "éa", "ÉA", "zé", "zz", "日本", "𝒳y", "a", "ab", "abc", "b1c", "x_y", "don't", "ÀB-c"]
    for i in range(240):
        lang, source = rng.choice(["en", "de", None, "fr"]), rng.choice(["s1", "s10", "s2", "", None, "ß", "日"])
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        rows.append((i % 200, text, lang, source, 1, 2, "x"))
    rows += [(900, None, "en", "empty", 1, 2, "x"), (901, "", "it", "only", 1, 2, "x"), (902, "1 2 3", "it", "second", 1, 2, "x")]
    rows += [(903 + i, "once" + "q" * i, "la", f"s{i}", 1, 2, "x") for i in range(3)]
    rows.append((990, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9000)), "en", "s1", 1, 2, "x"))
    schema = "doc_id long, text string, lang string, source string, ordinal int, n int, sid string"
    return spark.createDataFrame(rows, schema)


def test_audit_equals_brute_force(mixed):
    rows = mixed.collect()
    got = divergence.audit(mixed)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    held = [tuple(r) for r in got.collect()]
    want = brute(rows)
    assert len(held) == len(set(held)) and set(held) == want


def test_small_packs_and_blocks_change_nothing(mixed, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 2)
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 5)
    monkeypatch.setattr(divergence, "GATHER", 20)
    want = brute(mixed.collect(), 2, 3)
    got = divergence.audit(mixed, min_docs=2, top_terms=3, shard_terms=4, pack_bytes=600)
    held = [tuple(r) for r in got.collect()]
    assert len(held) == len(set(held)) and set(held) == want


def test_empty_and_termless_tables(spark, none):
    assert divergence.audit(none).count() == 0
    few = spark.createDataFrame([(1, "a b", "en", "x"), (2, "a", "en", "y")], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(few).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_transducer_is_minimal_and_exact():
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))).encode() for _ in range(700)})
    made = transducer.build(terms)
    probes = [*terms, *(t + b"x" for t in terms[:50]), *(t[:-1] for t in terms), b"zzz"]
    probes = [p for p in probes if p]
    data = np.frombuffer(b"".join(probes), np.uint8)
    ends = np.cumsum([len(p) for p in probes])
    starts = ends - [len(p) for p in probes]
    place = {t: i for i, t in enumerate(terms)}
    assert made.ordinals(data, starts, ends).tolist() == [place.get(p, -1) for p in probes]
    # As many states as different sets of endings.
    endings = defaultdict(set)
    for t in terms:
        for i in range(len(t) + 1):
            endings[t[:i]].add(t[i:])
    assert len(made.final) == len({frozenset(e) for e in endings.values()})
    assert len(transducer.build([]).keys) == 0
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])
