"""Words, runs and layer means against plain loops, and the shape of their plans."""

import random
import re

from linescope.operators import attention as A
from linescope.plans import attention as P

SCHEMA = "func_id long, layer int, stmt_id int, start int, tokens array<string>, weights array<double>"
MARK = A.SPACE_MARK


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def loop_words(tokens, weights, legacy_tail):
    """Words of a statement, a token at a time."""
    first = next((i for i, w in enumerate(weights) if w), None)
    if first is None:
        return []
    out, own, i = [], [first], first + 1
    while i < len(tokens):
        marked, after_zero = tokens[i].startswith(MARK), weights[i - 1] == 0
        if weights[i] == 0 and (marked or after_zero):
            break
        if weights[i] and (marked or after_zero):
            out.append(own)
            own = []
        if weights[i]:
            own.append(i)
        i += 1
    out.append(own)
    if legacy_tail and i == len(tokens) and weights[-1]:
        out.pop()
    return [("".join(tokens[k] for k in o).removeprefix(MARK), sum(weights[k] for k in o) / len(o)) for o in out]


def drawn(n, seed=3):
    r = random.Random(seed)
    for f in range(n):
        size = r.randint(1, 14)
        tokens = [r.choice(["", "", "", MARK]) + r.choice(["a", "Bc", "x1", "_", "é"]) for _ in range(size)]
        yield (f, 11, 1, 1, tokens, [r.choice([0.0, 0.25, 0.5, 1.0, 1.5, 2.0]) for _ in range(size)])


def test_words_and_spans_are_those_of_a_loop(spark):
    rows = [*drawn(300), (900, 11, 1, 1, [MARK + "ab"] + ["cd"] * 9, [0.5] * 10), (901, 11, 1, 1, ["a", "b"], [0.0, 0.0])]
    df = A.layer_mean(spark.createDataFrame(rows, SCHEMA))
    for tail in (False, True):
        want = sorted((f, k, w, round(x, 9)) for f, _, _, _, t, v in rows for k, (w, x) in enumerate(loop_words(t, v, tail), 1))
        assert sorted((r["func_id"], r["word_no"], r["word"], round(r["weight"], 9)) for r in A.words(df, tail).collect()) == want
    spans = {r["func_id"]: (r["span_start"], r["span_weights"]) for r in A.statement_spans(df).collect()}
    for f, _, _, _, _, v in rows:
        first = next((i for i, w in enumerate(v) if w), None)
        end = next((i for i in range(first or 0, len(v)) if v[i] == 0), len(v))
        assert spans.get(f) == (None if first is None else (first + 1, v[first:end]))


def test_words_are_put_together_outside_of_lambdas(spark):
    """The array of places is found once a statement; words are compiled code on rows of places."""
    df = A.layer_mean(spark.createDataFrame([*drawn(5)], SCHEMA))
    text = plan(A.token_weights(A.words(df)))
    above, _, below = text.partition("posexplode(")
    assert "lambdafunction" not in above and "lambdafunction" not in below.partition("\n")[0]
    assert text.count("StartsWith") <= 8 and "Filter isnotnull(CASE" not in text


def test_lines_are_cut_outside_of_lambdas(spark, sf):
    text = plan(P.statements(spark, sf))
    assert "regexp_replace" not in text and not re.search(r"lambdafunction\([^\n]*slice\(", text)


def test_layer_mean_of_layers_apart(spark):
    rows = [
        (1, 9, 1, 1, ["a", "b"], [0.5, 1.0]), (1, 10, 1, 1, ["a", "b"], [1.0, 0.0]), (1, 11, 1, 1, ["a", "b"], [1.5, 2.0]),
        (2, 10, 1, 3, ["c"], [3.0]), (2, 11, 1, 5, ["e", "f"], [6.0, 9.0]), (3, 11, 1, 2, ["z"], [3.0]),
    ]
    got = A.layer_mean(spark.createDataFrame(rows, SCHEMA), (9, 10, 11))
    assert "aggregate(" not in plan(got)
    assert {r["func_id"]: (r["start"], r["tokens"], r["weights"]) for r in got.collect()} == {
        1: (1, ["a", "b"], [1.0, 1.0]), 2: (3, ["c", None, "e", "f"], [1.0, 0.0, 2.0, 3.0]), 3: (2, ["z"], [1.0]),
    }
