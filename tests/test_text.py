"""Hand-worked inputs for the text expressions, the line scopes and the diff alignment."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linescope.functions import text as T
from linescope.operators import diffs, scopes


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, mode, lines",
    [
        ("a\nb\n", "newline", ["a", "b", ""]),
        ("a\nb\n", "universal", ["a", "b"]),
        ("a\r\nb\rc\x0bd\x0ce\x1cf\x85g" + chr(0x2028) + "h" + chr(0x2029) + "i", "universal", list("abcdefghi")),
        ("a\r\nb\rc", "newline", ["a\r", "b\rc"]),
        ("", "newline", [""]),
        ("", "universal", []),
        ("\n\n", "universal", ["", ""]),
    ],
)
def test_split_lines(spark, text, mode, lines):
    assert one(spark, text, lambda c: T.split_lines(c, mode)) == lines


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028), max_size=12), min_size=1, max_size=30))
def test_split_lines_equals_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.split_lines(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r["y"] == r["x"].splitlines()


@pytest.mark.parametrize(
    "line, want",
    [
        ("x // y // z", "x "),
        ("a /* b */ c /* d */ e", "a  c /* d */ e"),
        ("*/ x /* y", "*/ x  x /* y"),
        ("a /* open", "a /* open"),
        ("/* c */ s // t", "/* c */ s "),
    ],
)
def test_clean_line(spark, line, want):
    assert one(spark, line, T.clean_line) == want


@pytest.mark.parametrize(
    "line, want",
    [("a // b", "a "), ("a /* b */ c /* d */ e", "a  c  e"), ("s = \"http://x\"", 's = "http:'), ("/* open", "/* open")],
)
def test_strip_comments(spark, line, want):
    assert one(spark, line, T.strip_comments) == want


def test_line_key_drops_unicode_space(spark):
    assert one(spark, " a\xa0b\t\x1cc\x85d // e", T.line_key) == "abcd"


@pytest.mark.parametrize(
    "word, want",
    [
        ("getUserName", ["getUser", "ame"]),
        ("NULL", ["NUL", "L"]),
        ("a_b", ["a", "_", "b"]),
        ("Ab1", ["b", "1"]),
        ("A", ["A"]),
        ("é", []),
        ("x->y", ["x", "->", "y"]),
        ("", []),
    ],
)
def test_camel_pieces(spark, word, want):
    assert one(spark, word, T.camel_pieces) == want


def test_code_tokens(spark):
    got = one(spark, "if (a_b&&c<=d) e+=1; f->g || h", T.code_tokens)
    assert got == ["if", "a", "b", "&", "&", "c", "<=", "d", "e", "+=", "1", "f", "-", ">", "g", "||", "h"]


def test_chunk_tokens(spark):
    assert one(spark, "Foo a 1a a1 aka x.y 12 b;", T.chunk_tokens) == ["foo", "a1", "x.y", "b;"]


def test_ngrams(spark):
    got = one(spark, "a b c", lambda c: T.word_ngrams(F.split(c, " "), 4))
    assert got == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, "ab\U0001f600c", lambda c: T.char_ngrams(c, 2, 3)) == ["ab", "b\U0001f600", "\U0001f600c", "ab\U0001f600", "b\U0001f600c"]
    assert one(spark, "A \n\tB c", T.fold_text) == "a b c"


def test_single_line(spark):
    df = spark.createDataFrame([(1, " a\nb\r\n"), (None, None)], "s int, t string")
    got = [r["v"] for r in df.select(T.single_line(F.col("s"), F.col("t")).alias("v")).collect()]
    assert got == ["1<CODESPLIT>a b", "nan<CODESPLIT>nan"]


def test_clean_changes(spark):
    assert one(spark, "a##<END>##\nb##<END>##\rc##<END>##", T.clean_changes) == "abc##<END>##"


# --- scopes: lines l1..l5 ------------------------------------------------------------------

CODE = "l1\nl2\nl3\nl4\nl5"


def cut(spark, vul, scope, code=CODE, **options):
    df = spark.createDataFrame([("k", code, vul, 1)], "key string, func_before string, vul_line string, severity int")
    return scopes.cut_scope(df, scope, **options).first()["code"].split("\n")


@pytest.mark.parametrize(
    "vul, scope, options, want",
    [
        ("1 5", "whole", {}, ["l1", "l2", "l3", "l4", "l5"]),
        ("2 2 1", "code", {}, ["l2", "l2", "l1"]),
        ("1 5", "context_only", {}, ["l2", "l3", "l4"]),
        ("1 2 3 4 5", "context_only", {}, [""]),
        (None, "context_only", {}, ["l1", "l2", "l3", "l4", "l5"]),
        ("5 6 x 0", "lines_without_context", {}, ["l5"]),
        (None, "lines_without_context", {}, [""]),
        (None, "lines_without_context", {"default_first_line": True}, ["l1"]),
        ("x", "lines_without_context", {"default_first_line": True}, ["l1"]),
        # window 0..2 of v=1 with size 1: index 0 is dropped or wraps to the last line
        ("1", "surrounding_context", {"size": 1}, ["l1", "l2"]),
        ("1", "surrounding_context", {"size": 1, "legacy_wrap": True}, ["l5", "l1", "l2"]),
        # the right bound is n-1, so a changed last line is left out
        ("5", "surrounding_context", {"size": 1}, ["l4"]),
        ("5", "surrounding_context", {"size": 0}, [""]),
        ("6", "surrounding_context", {"size": 1}, [""]),
        (None, "surrounding_context", {}, [""]),
        ("2", "surrounding_only", {"size": 1}, ["l1", "l3"]),
        ("1", "surrounding_only", {"size": 1, "legacy_wrap": True}, ["l5", "l2"]),
        # the embedding variant keeps v in 0..n-1
        ("5", "surrounding_context", {"size": 1, "zero_based_guard": True}, [""]),
        ("0", "surrounding_context", {"size": 1, "zero_based_guard": True}, ["l1"]),
    ],
)
def test_scopes(spark, vul, scope, options, want):
    assert cut(spark, vul, scope, **options) == want


def test_surrounding_only_rejects_bad_numbers(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cut(spark, "1 x", "surrounding_only")


def test_random_context(spark):
    lines = set(CODE.split("\n"))
    got = cut(spark, "2 4", "random_context")
    assert len(got) == 2 and set(got) <= lines - {"l2", "l4"}
    # the candidates of the old rule leave out the line before
    got = cut(spark, "2 3 4 5", "random_context", legacy_candidates=True)
    assert got == ["l5"]
    assert cut(spark, "1 2 3 4 5", "random_context") == [""]
    assert cut(spark, "2 4", "random_context", seed=7) == cut(spark, "2 4", "random_context", seed=7)


def test_all_scopes_in_one_pass(spark):
    df = spark.createDataFrame([("k", CODE, "2", 1), ("m", CODE, None, 0)], "key string, func_before string, vul_line string, severity int")
    rows = scopes.cut_all_scopes(df).collect()
    assert len(rows) == 2 * len(scopes.SCOPES)
    for scope in scopes.SCOPES:
        apart = {r["key"]: r["code"] for r in scopes.cut_scope(df, scope).collect()}
        assert apart == {r["key"]: r["code"] for r in rows if r["scope"] == scope}


def align(spark, before, after, diff):
    df = spark.createDataFrame([("k", before, after, diff)], "key string, func_before string, func string, diff_func string")
    r = diffs.annotate_changed_lines(df).first()
    return r["delete_lines"], r["add_lines"]


def test_diff_alignment(spark):
    assert align(spark, "q\na\nb\na", "q", "-a\n-x\n-b\n-a") == ("2 3 4", "")
    # file headers count as signed lines; an empty key meets blank and comment-only lines
    before = "x\n--a.c\n // only\ny"
    assert align(spark, before, "x\ny\nz", "--- a.c\n+++ b.c\n@@ -1,2 +1,2 @@\n-\n-  y\n+z // new\n other") == ("2 3 4", "3")
    assert align(spark, "a  b", "c", "-a b /* c */\n+c") == ("1", "1")


def test_hunks(spark):
    df = spark.createDataFrame([("k", "@@ -3,4 +5,6 @@ f\n a\n@@ -10 +12 @@")], "key string, diff_func string")
    got = [tuple(r) for r in diffs.hunks(df).collect()]
    assert got == [("k", 1, 3, 5), ("k", 3, 10, 12)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", " a ", "c // x", ""]), min_size=1, max_size=8), st.lists(st.sampled_from(["-a", "-b", "-c", "-", " a"]), max_size=8))
def test_alignment_equals_brute_force(spark, lines, diff):
    keys = ["".join(x.split("//")[0].split()) for x in lines]
    cursor, want = 0, []
    for d in diff:
        if d.startswith("-"):
            for i in range(cursor, len(keys)):
                if keys[i] == d[1:]:
                    want.append(i + 1)
                    cursor = i + 1
                    break
    got, _ = align(spark, "\n".join(lines), "", "\n".join(diff))
    assert [int(x) for x in got.split()] == want
    assert want == sorted(set(want))


def test_long_diff_with_far_lines_ends_soon(spark):
    """50 000 changed lines; half of them are found only far behind the cursor or not at all."""
    import random
    import time

    rng = random.Random(1)
    after = [f"line {rng.randrange(9000)}" for _ in range(120_000)]
    diff, at = [], 0
    while len(diff) < 50_000:
        if rng.random() < 0.3:
            diff.append(f"+gone {len(diff)}")
            continue
        at = min(at + rng.choice([1, 1, 1, 1, 90]), len(after) - 1)
        diff.append("+" + after[at])
    df = spark.createDataFrame([("\n".join(after), "\n".join(after), "\n".join(diff))], ["func_before", "func", "diff_func"])
    begun = time.time()
    got = diffs.annotate_changed_lines(df).first()["add_lines"].split(" ")
    assert time.time() - begun < 60
    places, cursor, want = {}, 0, []
    for i, line in enumerate(after):
        places.setdefault(line, []).append(i)
    for line in diff:
        found = next((p for p in places.get(line[1:], ()) if p >= cursor), None)
        if found is not None:
            want.append(str(found + 1))
            cursor = found + 1
    assert got == want and len(want) > 5_000
