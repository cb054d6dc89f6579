import numpy as np
import pytest
from brute import near, shingles
from pyspark.sql import functions as F

from linescope.llm import minhash
from linescope.llm.graph import components
from linescope.llm.queries import QUERIES


def test_permutations_are_bijections():
    x = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4093)
    assert len(np.unique(minhash.sigma(x))) == len(x)
    assert len(np.unique(minhash.pi(x))) == len(x)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(3)
    both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    sets = [both[:600], both[200:]]
    made = minhash.signatures(np.concatenate(sets), np.array([0, 600, 1200]), 160)
    assert abs((made[0] == made[1]).mean() - 0.5) < 0.15


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).distinct().collect())
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("size", [2, 5])
def test_odd_rows_equal_brute_force(odd, odd_rows, size):
    got = minhash.near_duplicates(odd, size=size).collect()
    part, sets = near([(r[0], r[1]) for r in odd_rows], size)
    want = []
    for i, r in enumerate(odd_rows):
        keys = [odd_rows[j][0] for j in range(len(part)) if part[j] == part[i] and odd_rows[j][0] is not None]
        low = min(keys, default=None)
        want.append((r[0], len(sets[i]), low, r[0] is not None and r[0] == low))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark, sf, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
    part, sets = near(rows, 2)
    got = {r["doc_id"]: r for r in QUERIES["op1_minhash_near_dedup"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, (doc, _) in enumerate(rows):
        assert (got[doc]["n_shingles"], got[doc]["component_id"]) == (len(sets[i]), rows[part[i]][0])
        assert got[doc]["kept"] == (doc == rows[part[i]][0])


def test_large_group_with_outsiders_closes(spark, monkeypatch):
    """Blocks and pairs find the same components."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        w = list(base)
        for j in range(i % 9):
            w[(i * 7 + j * 13) % 60] = f"x{i}_{j}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    part, _ = near(list(enumerate(texts)), 2)
    for small in (1 << 30, 0):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
        got = {r[0]: r[2] for r in minhash.near_duplicates(docs, size=2).collect()}
        assert [got[i] for i in range(120)] == part


def test_shared_counts_are_intersections():
    rng = np.random.default_rng(1)
    left = [np.unique(rng.integers(0, 50, 20)) for _ in range(7)]
    right = [np.unique(rng.integers(0, 50, 20)) for _ in range(5)]
    got = np.concatenate([c for _, c in minhash._shared_counts(left, right)])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for a in left] for b in right]


def test_one_of_each(odd, odd_rows, none):
    rows = minhash.one_of_each(odd, size=2)
    assert rows.columns == odd.columns
    got = [r["text"] for r in rows.collect()]
    part, sets = near([(r[0], r[1]) for r in odd_rows], 2)
    worded = {part[i] for i in range(len(part)) if sets[i]}
    assert len([t for t in got if shingles(t, 2)]) == len(worded)
    assert len([t for t in got if not shingles(t, 2)]) == sum(not s for s in sets)
    assert minhash.one_of_each(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0


def test_key_types(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "q")], "id string, body string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, "id", "body", 2).select("id", "component_id", F.col("kept")).collect()))
    assert got == [("a", "a", True), ("b", "a", False), ("c", "c", True)]
