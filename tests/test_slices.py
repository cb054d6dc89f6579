"""Program slices against hand-worked functions and a closure by edges."""

import random
import re

from pyspark.sql import functions as F

from linescope.operators import slices

SCHEMA = "key long, severity int, func_before string, vul_line string"


def numbers(spark, data):
    df = spark.createDataFrame(data, "key long, lines array<string>, marked array<int>")
    return {r["key"]: r["n"] for r in df.select("key", slices.slice_numbers(F.col("lines"), F.col("marked")).alias("n")).collect()}


def test_names_of_a_line(spark):
    cases = {
        "int x = y + 1;": (["x"], {"int", "y"}),
        "a[i] += b;": (["a"], {"a", "i", "b"}),
        "if (p == q && r != s) t <<= u;": (["t"], {"if", "p", "q", "r", "s", "t", "u"}),
        "i++; --j;": (["i", "j"], {"i", "j"}),
        "a=b=c": (["a", "b"], {"c"}),
        "o->f = g(h);": (["f"], {"o", "g", "h"}),
        "while (x <= 3)": ([], {"while", "x"}),
        "": ([], set()),
    }
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    for r in df.select("line", slices.definitions(F.col("line")).alias("d"), slices.uses(F.col("line")).alias("u")).collect():
        assert (sorted(r["d"]), set(r["u"])) == (cases[r["line"]][0], cases[r["line"]][1])


def test_slice_takes_nearest_definitions_only(spark):
    lines = ["a = 1", "b = 2", "a = 3", "c = a", "d = b", "a = 9", "call(c)", "e = d"]
    got = numbers(spark, [(1, lines, [7]), (2, lines, [8]), (3, lines, []), (4, lines, [0, 99, 8, 8]), (5, [], [1]), (6, None, [1])])
    assert got == {1: [3, 4, 7], 2: [2, 5, 8], 3: [], 4: [2, 5, 8], 5: [], 6: None}


def test_slice_equals_a_closure_by_edges(spark):
    draw = random.Random(3)
    data, want = [], {}
    for key in range(60):
        names = [f"v{i}" for i in range(draw.randint(1, 6))]
        sides = [(draw.choice(names), [draw.choice(names) for _ in range(draw.randint(0, 3))]) for _ in range(draw.randint(1, 20))]
        marked = [draw.randint(1, len(sides)) for _ in range(draw.randint(0, 3))]
        data.append((key, [f"{d} = f({', '.join(u)});" for d, u in sides], marked))
        seen, todo = set(), list(marked)
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                for name in sides[i - 1][1]:
                    todo += [max(above)] if (above := [j for j in range(1, i) if sides[j - 1][0] == name]) else []
        want[key] = sorted(seen)
    assert numbers(spark, data) == want


def test_slices_are_a_projection_and_add_lines(spark):
    code = "a = 1;\nb = 2;\nuse(a); // why"
    df = spark.createDataFrame([(1, 3, code, "3"), (2, 3, code, None), (3, 3, "", "1"), (4, 3, None, "1"), (1, 3, code, "3")], SCHEMA)
    out = slices.cut_slice(df.withColumn("code", F.lit("kept out")).withColumn("lines", F.lit(0)))
    got = sorted(((r["key"], r["code"]) for r in out.collect()), key=str)
    assert [k for k, _ in got] == [1, 1, 2, 3, 4]
    assert got[0] == got[1] and re.sub(r"\s+$", "", got[0][1]) == "a = 1;\nuse(a);"
    assert [c for _, c in got[2:]] == ["", "", None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert slices.cut_slice(df.where("false")).count() == 0
