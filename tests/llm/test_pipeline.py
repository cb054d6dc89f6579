import corpus_pipeline
from brute import boilerplate, leaks, near, rules, without

import __spark_entry__ as entry
from linescope.llm import lines, quality_rules


def expected(docs, bench):
    keep = rules(
        [(r["text"], r["lang"], r["source"]) for r in docs],
        quality_rules.LEAST_SPREAD, quality_rules.SPREAD, quality_rules.GROUP_ROWS, quality_rules.TWO_SIDED,
    )
    rows = [r for r, k in zip(docs, keep, strict=True) if k]
    bad = boilerplate([(r["text"], r["source"]) for r in rows], lines.MIN_SITES, lines.CONTEXT_SHARE)
    rows = [(r["doc_id"], without(r["text"], bad)) for r in rows]
    part, sets = near(rows, 5)
    rows = [r for i, r in enumerate(rows) if part[i] == i]
    hit = {d for d, _ in leaks([t for _, t in rows], bench)}
    return {r[0]: r[1] for i, r in enumerate(rows) if i not in hit}


def test_run_equals_brute_force(spark, sf, documents):
    docs = documents.orderBy("doc_id").collect()
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = expected(docs, bench)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(want) and len(got) == len(want)
    assert 0 < len(want) < len(docs) and all(r["round_trip"] for r in got)


def test_stages_keep_the_columns(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece",
    ]
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert set(entry.oracle_sql()) <= set(names)
