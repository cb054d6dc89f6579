"""Aligning a unified diff with the two versions of a function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.rows import exploded
from linescope.functions.text import bind, line_key, split_lines

NEAR = 64  # lines looked at before the place list is searched
HITS = 256  # hits that are appended to one array
HUNK = "^@@ -(\\d+)(?:,\\d+)? \\+(\\d+)"


def _place_list(keys: Column) -> Column:
    """(key, place) of every line in ascending order: the places of a key stand together."""
    return F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("place"))))


def _first_from(places: Column, key: Column, place: Column) -> Column:
    """Smallest place of ``key`` that is not below ``place``, by halving; null without one."""

    def search(target: Column, halvings: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            def at(mid: Column) -> Column:
                above = F.struct((mid + 1).alias("low"), s["high"].alias("high"))
                return F.when(F.get(places, mid) < target, above).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

            return F.when(s["low"] < s["high"], bind(at, F.floor((s["low"] + s["high"]) / 2).cast("int"))).otherwise(s)

        whole = F.struct(F.lit(0).alias("low"), F.size(places).alias("high"))
        return F.get(places, F.aggregate(halvings, whole, halve, lambda s: s["low"]))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(places) + 1)).cast("int"))
    found = bind(search, F.struct(key.alias("key"), place.alias("place")), steps)
    return bind(lambda f: F.when(f["key"] == key, f["place"]), found)


def _matched(diff_lines: Column, code_lines: Column, sign: str) -> Column:
    """1-based numbers of the code lines that carry the diff lines beginning with ``sign``.

    Greedy from top to bottom: a hit moves the cursor behind it, a miss leaves it. Most lines stand close behind the last
    hit; where one does not, the place list, made once for the text, is searched by halving.
    """
    signed = F.filter(diff_lines, lambda d: d.startswith(sign))
    wanted = F.transform(signed, lambda d: line_key(F.substr(d, F.lit(2))))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("cursor"), none.alias("open"), F.array().cast("array<array<int>>").alias("full"))

    def walk(keys: Column, places: Column) -> Column:
        def step(state: Column, key: Column) -> Column:
            cursor = state["cursor"]

            def found(near: Column) -> Column:
                far = _first_from(places, key, cursor) + 1
                return bind(moved, F.when(near > 0, cursor + near).otherwise(far))

            def moved(at: Column) -> Column:
                # Hits are kept in short arrays, so that a long list is not copied for each of them.
                closed = F.size(state["open"]) >= HITS
                return F.when(at.isNull(), state).otherwise(
                    F.struct(
                        at.alias("cursor"),
                        F.when(closed, F.array(at)).otherwise(F.array_append(state["open"], at)).alias("open"),
                        F.when(closed, F.array_append(state["full"], state["open"])).otherwise(state["full"]).alias("full"),
                    )
                )

            return bind(found, F.array_position(F.slice(keys, cursor + 1, F.lit(NEAR)), key).cast("int"))

        return F.aggregate(wanted, start, step, lambda s: F.flatten(F.array_append(s["full"], s["open"])))

    return bind(lambda keys: bind(lambda places: walk(keys, places), _place_list(keys)), F.transform(code_lines, line_key))


def annotate_changed_lines(
    df: DataFrame, before: str = "func_before", after: str = "func", diff: str = "diff_func"
) -> DataFrame:
    """Add ``add_lines`` and ``delete_lines``, space-joined 1-based line numbers.

    One projection per function row: no shuffle, no Python.
    """
    diff_lines = split_lines(F.col(diff), "newline")
    deleted = _matched(diff_lines, split_lines(F.col(before), "newline"), "-")
    added = _matched(diff_lines, split_lines(F.col(after), "newline"), "+")

    def as_text(numbers: Column) -> Column:
        return F.array_join(F.transform(numbers, lambda i: i.cast("string")), " ")

    return df.withColumn("add_lines", as_text(added)).withColumn("delete_lines", as_text(deleted))


def hunks(df: DataFrame, key: str = "key", diff: str = "diff_func") -> DataFrame:
    """One row per hunk header: its place in the diff and the two start lines."""
    lines = split_lines(F.col(diff), "newline")
    return (
        exploded(df, [F.col(key).alias("key")], lines, "line", "pos")
        .where(F.col("line").startswith("@@"))
        .select(
            "key",
            (F.col("pos") + 1).alias("diff_line_no"),
            F.regexp_extract("line", HUNK, 1).cast("int").alias("start_before"),
            F.regexp_extract("line", HUNK, 2).cast("int").alias("start_after"),
        )
    )
