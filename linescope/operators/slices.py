"""Program slices: the annotated lines of a function with the lines that their values come from.

A line defines the names that it assigns or steps (``x = ..``, ``x[i] += ..``, ``x++``, ``--x``) and uses the other names on
it; a compound assignment, a step and an assignment to an element use their own name too. A use takes its value from the
nearest line above that defines the name. The slice is the backward closure of the annotated lines under that relation.

Lines are read as a straight sequence: branches, loops, calls, scopes of names, strings and comments are not told apart, and
a field is known by its own name. Remove comments before, where they hold code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.text import bind, clean_lines, split_lines
from linescope.operators.scopes import inside, parse_line_numbers, pick

NAME = "[A-Za-z_][A-Za-z0-9_]*"
#: Compound shifts are read as another compound, then comparisons are taken out; both hold an equals sign.
SHIFT = "<<=|>>="
COMPARISON = "[=!<>]="
#: Group 1 is a name that is assigned or stepped.
DEFINED = f"({NAME})[ \\t]*(?:\\[[^\\]]*\\][ \\t]*)?(?:[-+*/%&|^]?=|\\+\\+|--)"
STEPPED = f"(?:\\+\\+|--)[ \\t]*({NAME})"
#: An assignment that does not use the name it defines.
PLAIN = f"{NAME}[ \\t]*="


def bare(line: Column) -> Column:
    """The line without comparisons."""
    return F.regexp_replace(F.regexp_replace(line, SHIFT, "+="), COMPARISON, " ")


def definitions(line: Column) -> Column:
    """Distinct names that a line defines."""
    found = [F.regexp_extract_all(bare(line), F.lit(p), F.lit(1)) for p in (DEFINED, STEPPED)]
    return F.array_distinct(F.concat(*found))


def uses(line: Column) -> Column:
    """Distinct names that a line uses."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(bare(line), PLAIN, " "), F.lit(NAME), F.lit(0)))


def slice_numbers(lines: Column, marked: Column) -> Column:
    """Ascending 1-based numbers of the slice of the marked lines.

    One pass from the last line to the first carries the names whose definition is still to be found; only names that the
    function defines are carried. Marks outside the function and repeated marks change nothing; no marks give no lines.
    """

    def walked(rows: Column, defined: Column, marked: Column) -> Column:
        def step(state: Column, row: Column) -> Column:
            kept = F.array_contains(marked, row["no"]) | F.arrays_overlap(state["open"], row["sets"])
            still = F.array_union(F.array_except(state["open"], row["sets"]), F.array_intersect(row["uses"], defined))
            return F.struct(
                F.when(kept, still).otherwise(state["open"]).alias("open"),
                F.when(kept, F.concat(state["kept"], F.array(row["no"]))).otherwise(state["kept"]).alias("kept"),
            )

        start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<int>").alias("kept"))
        return F.aggregate(F.reverse(rows), start, step, lambda s: F.reverse(s["kept"]))

    def measured(lines: Column, marked: Column) -> Column:
        rows = F.transform(
            lines, lambda x, i: F.struct((i + 1).alias("no"), definitions(x).alias("sets"), uses(x).alias("uses"))
        )
        return bind(lambda rs: bind(lambda d: walked(rs, d, marked), F.array_distinct(F.flatten(rs["sets"]))), rows)

    return bind(measured, lines, F.array_distinct(inside(marked, lines)))


def cut_slice(
    df: DataFrame, key: str = "key", code: str = "func_before", vul_line: str = "vul_line", label: str = "severity"
) -> DataFrame:
    """Scoped-code table ``(key, severity, code)`` of program slices; a projection, as the other scopes are.

    A null text gives a null, an empty one or one without marks the empty code.
    """

    def cut(lines: Column, marked: Column) -> Column:
        return pick(lines, slice_numbers(lines, marked))

    kept = bind(cut, split_lines(F.col(code)), parse_line_numbers(F.col(vul_line)))
    return df.select(F.col(key).alias("key"), F.col(label), clean_lines(kept).alias("code"))
