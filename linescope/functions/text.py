"""Column expressions over code text. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
# Operator tokens, tried in this order, then runs of letters and digits.
CODE_OPERATORS = [
    "<=", ">=", "<", ">", "\\?", "\\/=", "\\+=", "\\-=", "\\+\\+", "--", "\\*=", "\\+", "-", "\\*",
    "\\/", "!=", "==", "=", "!", "&=", "&", "\\%", "\\|\\|", "\\|=", "\\|", "\\$", "\\:",
]
CODE_WORD = "[a-zA-Z0-9]+"
# A chunk holds a letter that is not its last character.
CHUNK = "\\S*[A-Za-z]\\S+"
STOP_WORDS = ["aka"]
# Separator between the files of one change.
CHANGE_SEPARATOR = "##<END>##[\r\n]"
# Characters that end a line under the "universal" rule (besides the pair \r\n).
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029)
# Marker a byte-pair tokenizer puts before a token that follows a space.
SPACE_MARK = "Ġ"
# Pieces of a word. Inside a letter run the head reaches up to the last capital, the tail is the
# lower-case run behind it, or that capital itself when it ends the run; other letters vanish.
CAMEL_PIECE = "[a-zA-Z]+(?=[A-Z])|[a-z]+|[A-Z]+(?=[^a-zA-Z]|$)|\\p{Nd}+|_+|[^\\p{L}\\p{N}_]+"
# ----------------------------------------------------------------------------------------



def bind(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` applied to ``values``, each computed once per row.

    A column used inside a lambda is computed again for every element; a lambda variable is not.
    """
    row = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(row), lambda r: body(*[r[f"v{i}"] for i in range(len(values))])), F.lit(0))


CODE_TOKEN = "(?:" + "|".join(CODE_OPERATORS) + ")|(?:" + CODE_WORD + ")"


def split_lines(text: Column, mode: str = "universal") -> Column:
    """Lines of ``text``.

    ``newline`` cuts at ``\\n`` only and keeps a final empty line; ``universal`` cuts at every
    Unicode line end and drops a final empty line. The two number lines differently on text
    with other line ends.
    """
    if mode == "newline":
        return F.split(text, "\n", -1)
    if mode != "universal":
        raise ValueError(f"unknown line mode {mode!r}")
    return bind(
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
        F.split(text, "\r\n|[" + LINE_ENDS + "]", -1),
    )


def strip_comments(line: Column) -> Column:
    """Cut ``//`` to the line end, then every closed ``/* */`` block."""
    return F.regexp_replace(F.regexp_replace(line, "//[^\n]*", ""), "(?s)/\\*.*?\\*/", "")


def line_key(line: Column) -> Column:
    """Comparison key of a line: no comments, no whitespace."""
    return F.regexp_replace(strip_comments(line), "(?U)[\\s\\x1c-\\x1f]+", "")


def clean_line(line: Column) -> Column:
    """Cut at ``//``; a line without it loses its first block comment.

    Where ``*/`` precedes ``/*`` the kept head and tail overlap and text is doubled.
    """
    slashes = F.instr(line, "//")
    opening = F.instr(line, "/*")
    closing = F.instr(line, "*/")
    return (
        F.when(slashes > 0, F.substr(line, F.lit(1), slashes - 1))
        .when(
            (opening > 0) & (closing > 0),
            F.concat(F.substr(line, F.lit(1), opening - 1), F.substr(line, closing + 2)),
        )
        .otherwise(line)
    )


def clean_lines(lines: Column) -> Column:
    """Join cleaned lines back to one text."""
    return F.array_join(F.transform(lines, clean_line), "\n")


def code_tokens(text: Column) -> Column:
    """Operators and alphanumeric runs, case kept."""
    return F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(0))


def chunk_tokens(text: Column) -> Column:
    """Lower-cased whitespace-free chunks, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?U)" + CHUNK), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def word_ngrams(tokens: Column, max_n: int, min_n: int = 1) -> Column:
    """Space-joined runs of ``min_n``..``max_n`` neighbouring tokens."""


    def runs(words: Column, n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    def grams(words: Column) -> Column:
        return F.concat(*[runs(words, n) for n in range(min_n, max_n + 1)])

    return bind(grams, tokens)


def fold_text(text: Column) -> Column:
    """Lower case, runs of two or more whitespace characters become one space."""
    return F.regexp_replace(F.lower(text), "(?U)[\\s\\x1c-\\x1f]{2,}", " ")


def char_ngrams(folded: Column, min_n: int, max_n: int) -> Column:
    """All character runs of ``min_n``..``max_n``, one linear pass per length.

    The look-ahead captures the run and the consumed dot steps one character, so the cost does
    not depend on the position inside a long text.
    """

    def grams(t: Column) -> Column:
        parts = [F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(min_n, max_n + 1)]
        return F.concat(*parts)

    return bind(grams, folded)


def clean_changes(text: Column) -> Column:
    """Drop the separator between the files of one change."""
    return F.regexp_replace(text, CHANGE_SEPARATOR, "")


def camel_pieces(word: Column) -> Column:
    """Pieces of a word by letter case, digits, underscores and symbols."""
    return F.regexp_extract_all(word, F.lit(CAMEL_PIECE), F.lit(0))


def single_line(label: Column, text: Column, separator: str = "<CODESPLIT>") -> Column:
    """``label<separator>text`` with newlines turned to spaces; NULL prints ``nan``."""
    ends = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

    def trim(c: Column) -> Column:
        return F.trim(c, F.lit(ends))

    left = trim(F.coalesce(label.cast("string"), F.lit("nan")))
    right = trim(F.regexp_replace(F.coalesce(text, F.lit("nan")), "\n", " "))
    return F.concat(left, F.lit(separator), right)


def stringify(col: Column, null_text: str = "nan") -> Column:
    """Cell as text, NULL as ``null_text``."""
    return F.coalesce(col.cast("string"), F.lit(null_text))
