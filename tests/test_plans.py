"""Shape of the physical plans: no pair joins, no Python in the row path, pruned scans."""

import pytest

from linescope.plans.catalog import QUERIES

# Queries that train models or write files run whole jobs while the plan is built.
SKIP = ("a02", "a03", "a04", "b04", "d12", "d17", "e08_statement_listing_files", "f01", "f02", "f03", "f04", "f05", "f08")
# p-values of result rows, and neighbours by distance matrices.
PYTHON = {"f06_neighbours_uniform_l2", "f06_neighbours_distance_l1", "g08_compare_p_values", "g08_compare", "g05_mann_whitney", "g06_wilcoxon"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith(SKIP)))
def test_no_pair_joins_and_no_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "EvalPython" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", ["c03_diff_alignment", "c06_scope_whole", "d01_code_tokens", "e03_words"])
def test_projection_reads_two_columns(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text or "ReadSchema: struct<text:string>" in text


@pytest.mark.parametrize("name", ["c03_diff_alignment", "c06_scope_whole", "c12_scope_surrounding_only", "c13_scope_random_context"])
def test_line_scopes_do_not_shuffle(spark, name):
    """On an input with enough splits a scope is one projection."""
    from linescope.operators import diffs, scopes

    df = spark.createDataFrame([("k", "a\nb", "a\nc", "-b\n+c", "2", 1)], "key string, func_before string, func string, diff_func string, vul_line string, severity int")
    kind = {"c06": "whole", "c12": "surrounding_only", "c13": "random_context"}.get(name[:3])
    out = scopes.cut_scope(df, kind) if kind else diffs.annotate_changed_lines(df)
    assert "Exchange" not in plan(out)


def test_sizes_of_sides_come_to_the_rows(spark):
    """Rows of a comparison do not meet the sizes of their few scenarios by a shuffle on the scenario alone."""
    import re

    from linescope.operators import stats

    rows = [("s", "AB"[i % 3 == 0], f"k{i:02d}", float(i)) for i in range(30)] + [("t", "A", "k", 1.0), (None, "B", "k", 2.0)]
    df = spark.createDataFrame(rows, "scenario string, side string, key string, value double")
    pairs = stats.paired(df)
    assert "BroadcastHashJoin" in plan(pairs) and not re.search(r"hashpartitioning\(scenario#\d+, \d", plan(pairs))
    got = pairs.where("scenario = 's'").collect()
    assert sorted(r["b"] for r in got) == [float(i) for i in range(0, 30, 3)] and len({r["a"] for r in got}) == 10
