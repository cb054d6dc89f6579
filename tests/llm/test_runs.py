"""Periodic runs against brute force."""

import random
import time

import numpy as np
from brute import WORD

from linescope.llm import runs


def plain_runs(words, least=runs.LEAST, power=runs.POWER):
    """(start, length, period) of every longest stretch with a smallest period that fits often enough."""
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                out.append((i, j - i + q, q))
            i = j
    return sorted(r for r in out if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in out))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts():
    rng = random.Random(11)
    out = []
    for _ in range(300):
        alphabet = rng.choice([1, 2, 3, 9])
        words = [str(rng.randrange(alphabet)) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [str(rng.randrange(alphabet)) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 8)
        out.append(words)
    a, b = ["0"], ["0", "1"]
    for _ in range(9):
        a, b = b, b + a
    return [*out, b, b * 4, [], ["x"] * 200]


def test_runs_equal_brute_force():
    texts = random_texts()
    ids = np.array([int(w) if w.isdigit() else 99 for t in texts for w in t], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = runs.find_runs(ids, first)
    want = [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]
    assert len(want) > 200 and [tuple(r) for r in got.tolist()] == want


def test_other_limits():
    texts = random_texts()[:80]
    ids = np.array([int(w) for t in texts for w in t], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for least, power in ((2, 2), (9, 3), (4, 5)):
        want = [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least, power)]
        assert [tuple(r) for r in runs.find_runs(ids, first, least, power).tolist()] == want


def test_ordered_places():
    rng, held, want = random.Random(3), runs.Places(50_000), [50_000]
    for x in rng.sample(range(50_000), 9_000):
        low, high = max((w for w in want if w < x), default=-1) if len(want) < 300 else None, None
        if low is not None:
            assert held.around(x)[0] == low
        held.add(x)
        want.append(x)
    assert list(held) == sorted(want) and held.size == len(want)
    want = sorted(want)
    assert held.around(want[4000] + 1) in [(want[4000], want[4001])] or want[4000] + 1 == want[4001]


def test_long_periodic_text_ends_soon():
    begun = time.time()
    ids = np.concatenate([np.zeros(200_000, np.int64), np.tile(np.arange(1000), 200)])
    got = runs.find_runs(ids, np.array([0, len(ids)]))
    assert got.tolist() == [[0, 0, 200_001, 1], [0, 200_000, 200_000, 1000]] and time.time() - begun < 60


def test_operator_on_odd_rows(spark, odd, odd_rows, none):
    extra = [(90, "a b " * 9 + "x", "en", "s", 1), (90, "a b " * 9 + "x", "en", "s", 1), (91, "Ä  ä\tÄ\nÄ Ä Ä Ä Ä", "en", "s", 1), (92, "A a A a A a A a", "en", "s", 1)]
    df = odd.select("doc_id", "text", "key", "n", "words", odd.key.alias("runs"), odd.n.alias("c0"))
    df = df.unionAll(spark.createDataFrame([(r[0], r[1], 1, 2, 5, 1, 2) for r in extra], df.schema))
    got = runs.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "key", "n", "words", "c0", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(odd_rows) + len(extra)
    for r in rows:
        words = WORD.findall(r["text"] or "")
        want = plain_runs(words) if len(words) < 2000 else []
        assert [tuple(x) for x in r["runs"]] == want and r["collapsed"] == collapsed(words, want)
    assert sum(bool(r["runs"]) for r in rows) == 4
    assert runs.periodic_runs(none).count() == 0
