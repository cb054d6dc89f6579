import random

import pytest
from brute import leaks

from linescope.llm import decontaminate
from linescope.llm.queries import QUERIES


@pytest.fixture(scope="module")
def bench(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_query_equals_brute_force(spark, sf, documents, bench):
    rows = documents.orderBy("doc_id").collect()
    want = leaks([r["text"] for r in rows], [(r["item_id"], r["text"]) for r in bench.collect()])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["op9_benchmark_decontamination"](spark, sf).collect()}
    assert got.keys() == {(rows[d]["doc_id"], i) for d, i in want}
    assert sorted(got.values()) == pytest.approx(sorted(want.values()))


def test_edited_items_are_found(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(20 + 7 * i))) for i in range(8)]
    items += [(50, "one two three"), (51, ""), (52, None), (53, "One"), (54, items[2][1])]
    docs = []
    for i, text in items[:8]:
        w = text.split()
        docs.append(f"before {text.upper()} after")
        docs.append(" ".join(["x", *w[:9], "NEW", *w[9:], "y"]))
        docs.append(" ".join(w[1:]))
        docs.append(" ".join(w[: len(w) // 2]))
    docs += ["zero one two three four", "nothing here", None, "", "one"]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(table, bench).collect()}
    want = {k: v for k, v in leaks(docs, items).items() if len(dict(items)[k[1]].split()) >= 5}
    assert {k: v for k, v in got.items() if k[1] < 50 or k[1] == 54} == pytest.approx(want)
    assert (32, 50) in got and (36, 53) in got and (32, 53) in got
    clean = decontaminate.without_leaks(table, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in got}


def test_odd_rows(odd, odd_rows, none, spark):
    bench = spark.createDataFrame([(1, odd_rows[0][1]), (2, None)], "item_id long, text string")
    got = decontaminate.without_leaks(odd, bench)
    assert got.columns == odd.columns
    words = odd_rows[0][1].split()
    hit = sum(1 for r in odd_rows if r[1] and r[1].lower().split()[:80] == words)
    assert got.count() == len(odd_rows) - hit
    nothing = bench.where("false")
    assert decontaminate.leaks(odd, nothing).count() == 0 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.without_leaks(odd, nothing).count() == len(odd_rows)


def test_joined_without_broadcast(spark, sf, documents, bench, monkeypatch):
    want = sorted(map(tuple, decontaminate.leaks(documents, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontaminate.leaks(documents, bench).collect())) == want


def test_fingerprint_votes(spark):
    rows = spark.createDataFrame([([3, 1, -1],), ([],), ([-(1 << 63), -(1 << 63), 1],)], "s array<long>")
    got = [r[0] for r in rows.select(decontaminate.fingerprint(rows["s"])).collect()]
    assert got == [3, 0, -(1 << 63)]


def test_index_covers_the_radius():
    assert len(decontaminate.FLIPS) == 1 + 8 + 28
    assert decontaminate.RADIUS < decontaminate.BLOCKS * 3


def test_no_python(spark, sf):
    plan = QUERIES["op9_benchmark_decontamination"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
