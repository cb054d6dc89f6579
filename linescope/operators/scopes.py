"""Line scopes: which lines of a function are kept as its code.

Every scope is a column expression over the line array of one row, so cutting a scope is a
projection without any shuffle. ``lines`` are 1-based in the annotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.rows import inlined
from linescope.functions.text import bind, clean_lines, split_lines
from linescope.operators.ranking import seeded_hash

_NO_INTS = "array<int>"


def parse_line_numbers(text: Column) -> Column:
    """Integers of a space-joined string; anything but digits is skipped, NULL gives none."""
    words = F.split(F.coalesce(text, F.lit("")), "\\s+")
    return F.transform(F.filter(words, lambda w: w.rlike("^[0-9]+$")), lambda w: w.cast("int"))


def strict_line_numbers(text: Column) -> Column:
    """Like :func:`parse_line_numbers`, but a word that is no integer raises."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")
    return F.transform(words, lambda w: w.cast("int"))


def pick(lines: Column, numbers: Column) -> Column:
    """Lines at the given 1-based numbers, order and repeats kept."""
    return F.transform(numbers, lambda i: F.get(lines, i - 1))


def inside(numbers: Column, lines: Column) -> Column:
    """Numbers that point at an existing line."""
    return F.filter(numbers, lambda v: (v >= 1) & (v <= F.size(lines)))


def other_lines(lines: Column, vul: Column) -> Column:
    """Lines whose number is not annotated, ascending."""
    return F.filter(lines, lambda _, i: ~F.array_contains(vul, i + 1))


def context_window(lines: Column, vul: Column, size: int = 5, zero_based_guard: bool = False) -> Column:
    """Sorted distinct indices ``max(0,v-size)..min(n-1,v+size)`` around every annotated line.

    ``zero_based_guard`` keeps v in 0..n-1, the embedding variant, in place of 1..n.
    """
    n = F.size(lines)
    low, high = (0, n - 1) if zero_based_guard else (1, n)
    kept = F.filter(vul, lambda v: (v >= low) & (v <= high))

    def span(v: Column) -> Column:
        start, end = F.greatest(F.lit(0), v - size), F.least(n - 1, v + size)
        return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast(_NO_INTS))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(kept, span))))


def from_window(lines: Column, indices: Column, legacy_wrap: bool = False) -> Column:
    """Lines for window indices read as 1-based numbers.

    Index 0 points before the first line: it is dropped, or with ``legacy_wrap`` it is the last
    line, put first.
    """
    if legacy_wrap:
        return F.transform(indices, lambda i: F.get(lines, F.when(i == 0, F.size(lines)).otherwise(i) - 1))
    return pick(lines, F.filter(indices, lambda i: i >= 1))


def random_lines(lines: Column, vul: Column, key: Column, seed: object = 42, legacy_candidates: bool = False) -> Column:
    """As many non-annotated lines as there are annotated ones, in md5 order.

    ``legacy_candidates`` leaves out the line before each annotated line instead of the line itself.
    """
    shift = 1 if legacy_candidates else 0
    numbered = F.transform(
        lines,
        lambda line, i: F.struct(
            seeded_hash(seed, key, i + 1).alias("h"), (i + 1).alias("no"), line.alias("line")
        ),
    )
    shuffled = F.array_sort(F.filter(numbered, lambda s: ~F.array_contains(vul, s["no"] + shift)))
    return F.transform(F.slice(shuffled, F.lit(1), F.size(vul)), lambda s: s["line"])


def scope_lines(
    scope: str,
    lines: Column,
    vul_text: Column,
    key: Column,
    size: int = 6,
    default_first_line: bool = False,
    legacy_wrap: bool = False,
    legacy_candidates: bool = False,
    zero_based_guard: bool = False,
    seed: object = 42,
) -> Column:
    """Kept lines of one scope.

    ``whole``, ``code``, ``context_only``, ``lines_without_context``, ``surrounding_context``,
    ``surrounding_only``, ``random_context``.
    """

    def cut(lines: Column, vul: Column, vul_text: Column) -> Column:
        if scope == "whole":
            return lines
        if scope == "code":
            return pick(lines, inside(vul, lines))
        if scope == "context_only":
            return other_lines(lines, vul)
        if scope == "lines_without_context":
            kept = F.when(F.size(vul) == 0, F.array(F.lit(1))).otherwise(vul) if default_first_line else vul
            return pick(lines, inside(kept, lines))
        if scope == "random_context":
            return random_lines(lines, vul, key, seed, legacy_candidates)
        around = context_window(lines, vul, size, zero_based_guard)
        if scope == "surrounding_only":
            around = F.array_except(around, strict_line_numbers(vul_text))
        return from_window(lines, around, legacy_wrap)

    if scope not in {*SCOPES, "code"}:
        raise ValueError(f"unknown scope {scope!r}")
    return bind(lambda ls, text: bind(lambda vul: cut(ls, vul, text), parse_line_numbers(text)), lines, vul_text)


SCOPES = [
    "whole",
    "lines_without_context",
    "surrounding_context",
    "context_only",
    "surrounding_only",
    "random_context",
]


def cut_scope(
    df: DataFrame,
    scope: str,
    key: str = "key",
    code: str = "func_before",
    vul_line: str = "vul_line",
    label: str = "severity",
    **options: object,
) -> DataFrame:
    """Scoped-code table ``(key, severity, code)``."""
    kept = scope_lines(scope, split_lines(F.col(code)), F.col(vul_line), F.col(key), **options)
    return df.select(F.col(key).alias("key"), F.col(label), clean_lines(kept).alias("code"))


def cut_all_scopes(df: DataFrame, **names: str) -> DataFrame:
    """All scopes as one table with a ``scope`` column, from one pass over the functions.

    Written with ``partitionBy("scope")`` a reader of one scope scans that scope only.
    """
    key, code = names.get("key", "key"), names.get("code", "func_before")
    vul, label = names.get("vul_line", "vul_line"), names.get("label", "severity")

    def cut(lines: Column, vul_text: Column) -> Column:
        kept = {s: scope_lines(s, lines, vul_text, F.col("key")) for s in SCOPES}
        return F.array(
            *[F.struct(F.lit(s).alias("scope"), clean_lines(rows).alias("code")) for s, rows in kept.items()]
        )

    base = df if key == "key" else df.withColumnRenamed(key, "key")
    rows = base.select("key", label, bind(cut, split_lines(F.col(code)), F.col(vul)).alias("_cut"))
    return inlined(rows, ["key", label], F.col("_cut"), "scope")


def project_scope_input(df: DataFrame, label: str = "severity") -> DataFrame:
    """(key, severity, code, vul_line) from an annotated function table; no annotation is ``""``."""
    return df.select(
        F.col("cve_id").alias("key"),
        label,
        F.col("func_before").alias("code"),
        F.coalesce(F.col("delete_lines").cast("string"), F.lit("")).alias("vul_line"),
    )
