import pytest
from brute import base_failed, boilerplate, measures, rules, without

from linescope.llm import lines, quality_rules
from linescope.llm.queries import QUERIES

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def expected(rows):
    kept = rules(
        rows, quality_rules.LEAST_SPREAD, quality_rules.SPREAD, quality_rules.GROUP_ROWS, quality_rules.TWO_SIDED
    )
    return [(*[measures(t)[c] for c in COUNTS], base_failed(measures(t)), k) for (t, _, _), k in zip(rows, kept, strict=True)]


def test_query_equals_brute_force(spark, sf, documents):
    rows = documents.orderBy("doc_id").collect()
    got = QUERIES["op6_quality_rules"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r)[1:8] for r in got] == expected([(r["text"], r["lang"], r["source"]) for r in rows])


def test_groups_have_their_own_thresholds(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "GROUP_ROWS", 5)
    plain = " ".join(f"w{i}" for i in range(60))
    many = " ".join(f"w{i} |" for i in range(60))
    rows = [(i, plain + f" {i}", "en", "a", 0) for i in range(8)] + [(20, many, "en", "a", 0)]
    rows += [(30 + i, many + f" {i}", "en", "b", 0) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()}
    assert not kept[20] and all(v for k, v in kept.items() if k != 20)


def test_rules_on_odd_rows(odd, odd_rows, none):
    got = sorted((tuple(r)[1:8] for r in quality_rules.verdicts(odd).collect()), key=str)
    assert got == sorted(expected([(r[1], r[2], r[3]) for r in odd_rows]), key=str)
    left = quality_rules.kept_rows(odd)
    assert left.columns == odd.columns
    assert left.count() == sum(r[-1] for r in got)
    assert quality_rules.verdicts(none).count() == 0 and quality_rules.kept_rows(none).count() == 0


def test_no_python_in_the_rules(spark, sf):
    plan = QUERIES["op6_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_lines_equal_brute_force(spark, sf, documents):
    rows = documents.orderBy("doc_id").collect()
    bad = boilerplate([(r["text"], r["source"]) for r in rows], lines.MIN_SITES, lines.CONTEXT_SHARE)
    got = QUERIES["op2_line_dedup"](spark, sf).orderBy("doc_id").collect()
    assert bad and [r["text"] for r in got] == [without(r["text"], bad) for r in rows]
    assert sum(r["n_removed"] for r in got) > 0


def test_copies_keep_their_lines(spark):
    body = "first line of the copy\nsecond line of it\nthird line"
    rows = [(i, body, f"s{i}") for i in range(12)]
    rows += [(20 + i, f"own {i}\nAll rights reserved.\nmore {i}", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = dict(lines.without_boilerplate(docs).select("doc_id", "text").collect())
    assert got[3] == body and got[23] == "own 3\nmore 3"


def kept_texts(spark, texts):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return [r["text"] for r in lines.without_boilerplate(docs).orderBy("doc_id").collect()]


def test_blank_lines_are_no_neighbours(spark):
    got = kept_texts(spark, [f"own {i}\n\nAll rights reserved.\n \nmore {i}" for i in range(12)])
    assert got == [f"own {i}\n\n \nmore {i}" for i in range(12)]


def test_blocks_of_lines_go_whole(spark):
    footer = "\n".join(f"footer {k}" for k in range(5))
    copy = "copied one\ncopied two\ncopied three"
    texts = [f"own {i}\n{footer}" for i in range(12)] + [f"{footer}\n\nown {i}" for i in range(12, 15)] + [copy] * 12
    assert kept_texts(spark, texts) == [f"own {i}" for i in range(12)] + [f"\nown {i}" for i in range(12, 15)] + [copy] * 12


def test_a_line_repeated_in_a_document_counts_once(spark):
    shared = "All rights reserved."
    texts = [f"own {i}\n{shared}\nmore {i}" for i in range(12)] + ["\n".join([shared] * 500)]
    assert kept_texts(spark, texts) == [f"own {i}\nmore {i}" for i in range(12)] + [""]


@pytest.mark.parametrize("sites", [4, 5])
def test_threshold_is_exact(spark, sites):
    rows = [(i, f"own {i}\nshared\nmore {i}", f"s{i % sites}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert lines.boilerplate(docs).count() == (sites >= lines.MIN_SITES)


def test_lines_on_odd_rows(odd, odd_rows, none):
    out = lines.without_boilerplate(odd, removed="gone")
    assert out.columns == [*odd.columns, "gone"]
    assert sorted((r["text"] for r in out.collect()), key=str) == sorted((r[1] for r in odd_rows), key=str)
    assert lines.without_boilerplate(none).count() == 0
