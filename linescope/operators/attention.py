"""Ranking tokens and statements by model attention.

The statement table has one row per ``(func_id, layer, stmt_id)`` with aligned arrays ``tokens``
and ``weights``: the slice of the function's tokens from the first to the last non-zero weight,
plus one more element where the function goes on, and ``start``, the 1-based place of the slice.
Everything inside a statement is a projection on that row; only the lookups and the corpus-wide
aggregates shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.rows import exploded
from linescope.functions.text import SPACE_MARK, bind, camel_pieces

LAST_LAYER = 11
LOCAL_SHARE = 0.7
LOW_RATED = 5000
CLOUD_MIN_FREQUENCY = 100
CLOUD_SCALE = 100000.0

# The keywords profiled by output_keywords.
CPP_KEYWORDS = [
    "asm", "auto", "bool", "break", "case", "catch", "char", "class", "const", "const_cast", "continue",
    "default", "delete", "do", "double", "dynamic_cast", "else", "enum", "explicit", "export", "extern",
    "false", "float", "for", "friend", "goto", "if", "inline", "int", "long", "mutable", "namespace", "new",
    "operator", "private", "protected", "public", "register", "reinterpret_cast", "return", "short", "signed",
    "sizeof", "static", "static_cast", "struct", "switch", "template", "this", "throw", "true", "try",
    "typedef", "typeid", "typename", "union", "unsigned", "using", "virtual", "void", "volatile", "wchar_t",
    "while",
]
KEYWORD_SCALE = 150


def trim_row(tokens: Column, weights: Column) -> Column:
    """Struct ``(start, tokens, weights)`` of a dense row; NULL where all weights are zero."""

    def cut(w: Column) -> Column:
        first = F.array_position(F.transform(w, lambda x: x != 0.0), True)
        last = F.size(w) - F.array_position(F.transform(F.reverse(w), lambda x: x != 0.0), True) + 1
        length = F.least(last + 1, F.size(w)) - first + 1
        return F.when(
            first > 0,
            F.struct(
                first.cast("int").alias("start"),
                F.slice(tokens, first.cast("int"), length.cast("int")).alias("tokens"),
                F.slice(w, first.cast("int"), length.cast("int")).alias("weights"),
            ),
        )

    return bind(cut, weights)


def skip_last_function(df: DataFrame) -> DataFrame:
    """Functions below the largest id, the enumeration that leaves out the last entry."""
    last = df.agg(F.max("func_id").alias("last")).scalar()
    return df.where(F.col("func_id") < last)


def layer_mean(df: DataFrame, layers: Sequence[int] = (LAST_LAYER,)) -> DataFrame:
    """Mean of the weights over the chosen layers, one row per statement.

    One layer is a filter. Several layers are brought side by side by an aggregate that holds one
    array per layer.
    """
    chosen = df.where(F.col("layer").isin([int(x) for x in layers]))
    if len(layers) == 1:
        return chosen.select("func_id", "stmt_id", "start", "tokens", "weights")
    sides = [
        F.max(F.when(F.col("layer") == x, F.struct("start", "tokens", "weights"))).alias(f"l{x}") for x in layers
    ]
    rows = chosen.groupBy("func_id", "stmt_id").agg(*sides)
    parts = [F.col(f"l{x}") for x in layers]
    # The outer functions leave out the layers that a statement does not have.
    low = F.least(*[p["start"] for p in parts])
    high = F.greatest(*[p["start"] + F.size(p["weights"]) - 1 for p in parts])
    ranged = rows.where(low.isNotNull()).select("*", low.alias("start"), (high - low + 1).alias("_n"))

    def padded(p: Column) -> Column:
        """Weights of a layer over the whole range, zeros where it has none."""
        before = p["start"] - F.col("start")
        after = F.col("_n") - before - F.size(p["weights"])
        same = (before == 0) & (after == 0)
        wide = F.concat(F.array_repeat(F.lit(0.0), before), p["weights"], F.array_repeat(F.lit(0.0), after))
        return F.when(p.isNull(), F.array_repeat(F.lit(0.0), F.col("_n"))).when(same, p["weights"]).otherwise(wide)

    total = padded(parts[0])
    for p in parts[1:-1]:
        total = F.zip_with(total, padded(p), lambda a, x: a + x)
    mean = F.zip_with(total, padded(parts[-1]), lambda a, x: (a + x) / float(len(layers)))

    def token_at(i: Column) -> Column:
        return F.coalesce(*[F.get(p["tokens"], i + F.col("start") - p["start"]) for p in parts])

    # Layers mostly hold the same tokens; only others are put together place by place.
    equal = [p.isNotNull() & (p["start"] == F.col("start")) & (F.size(p["tokens"]) == F.col("_n")) for p in parts]
    equal += [p["tokens"] == parts[0]["tokens"] for p in parts[1:]]
    alike = equal[0]
    for c in equal[1:]:
        alike = alike & c
    tokens = F.when(alike, parts[0]["tokens"]).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_n") - 1), token_at)
    )
    return ranged.select("func_id", "stmt_id", "start", tokens.alias("tokens"), mean.alias("weights"))


def weight_rows(df: DataFrame) -> DataFrame:
    """(func_id, stmt_id, pos, token, weight), one row per slice element."""
    zipped = F.arrays_zip("tokens", "weights")
    return exploded(df, ["func_id", "stmt_id", "start"], zipped, "z", "at").select(
        "func_id",
        "stmt_id",
        (F.col("start") + F.col("at")).alias("pos"),
        F.col("z.tokens").alias("token"),
        F.col("z.weights").alias("weight"),
    )


def first_weighted(weights: Column) -> Column:
    """1-based place of the first non-zero weight, 0 if there is none; mostly the first one, and no other is looked at."""
    return F.when(F.get(weights, F.lit(0)) != 0.0, 1).otherwise(
        F.array_position(F.transform(weights, lambda x: x != 0.0), True).cast("int")
    )


def first_run(tokens: Column, weights: Column) -> Column:
    """Struct ``(offset, tokens, weights)`` of the first run of non-zero weights."""

    def cut(w: Column, first: Column) -> Column:
        def run(rest: Column) -> Column:
            zero = F.array_position(rest, F.lit(0.0)).cast("int")
            n = F.when(zero > 0, zero - 1).otherwise(F.size(rest))
            return F.struct(first.alias("offset"), F.slice(tokens, first, n).alias("tokens"), F.slice(rest, F.lit(1), n).alias("weights"))

        return F.when(first > 0, bind(run, F.when(first == 1, w).otherwise(F.slice(w, first, F.size(w)))))

    return bind(cut, weights, first_weighted(weights))


def statement_spans(df: DataFrame) -> DataFrame:
    """Add ``span_start``, ``span_tokens``, ``span_weights``: the first non-zero run of a statement."""
    run = first_run(F.col("tokens"), F.col("weights"))
    return exploded(df, ["func_id", "stmt_id", "start"], F.array(run), "run").select(
        "func_id",
        "stmt_id",
        (F.col("start") + F.col("run.offset") - 1).alias("span_start"),
        F.col("run.tokens").alias("span_tokens"),
        F.col("run.weights").alias("span_weights"),
    )


def word_places(tokens: Column, weights: Column) -> Column:
    """1-based places of the words of a statement in order; the place that ends the statement early is negative.

    A word runs until the next token begins with the space mark or a zero weight follows. A zero
    inside a word ends the word and is stepped over; a zero on a token with the space mark, or a
    second zero, ends the statement. What stands behind a negative place is no word.
    """

    def places(t: Column, w: Column, first: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            begins = F.get(t, i).startswith(SPACE_MARK) | (F.get(w, i - 1) == 0.0)
            return F.when(x == 0.0, F.when((i >= first) & begins, -i - 1)).when(
                (begins | (i + 1 == first)) & x.isNotNull(), i + 1
            )

        return F.when(first > 0, F.array_compact(F.transform(w, place)))

    return bind(places, tokens, weights, first_weighted(weights))


def words(df: DataFrame, legacy_tail: bool = False) -> DataFrame:
    """(func_id, stmt_id, word_no, word, weight), the weight the mean of the word's pieces.

    ``legacy_tail`` loses a word that reaches the row end.
    """
    marked = df.select("func_id", "stmt_id", "tokens", "weights", word_places(F.col("tokens"), F.col("weights")).alias("_places"))
    end = F.array_position(F.transform("_places", lambda p: p < 0), True).cast("int")
    t, w, s = F.col("tokens"), F.col("weights"), F.col("_s")

    def behind(k: Column) -> Column:
        return F.abs(F.coalesce(F.get("_places", k + 1), F.size(w) + 1))

    def long_sum(s: Column, k: Column) -> Column:
        # A zero can only be the last of these, and adds nothing.
        return F.when(behind(k) - s > 3, F.aggregate(F.slice(w, s, behind(k) - s), F.lit(0.0), lambda a, x: a + x))

    counted = marked.select(
        "*",
        end.alias("_end"),
        F.transform("_places", lambda s, k: F.when(s > 0, long_sum(s, k))).alias("_sums"),
    )
    # A row is a place: behind this the words are put together by compiled code, which copies no array. A lambda there would.
    placed = exploded(counted, ["func_id", "stmt_id", "tokens", "weights", "_places", "_end", "_sums"], F.col("_places"), "_s", "_k")
    after = behind(F.col("_k"))
    # No plain comparison: the optimizer would compute the places once more, to filter by them before.
    inside = F.when(F.col("_end") > 0, F.col("_k") < F.col("_end") - 1).otherwise(True)
    rows = placed.where(inside).withColumn("_size", after - s - F.when(F.get(w, after - 2) == 0.0, 1).otherwise(0))
    if legacy_tail:
        rows = rows.where(F.get("_places", F.col("_k") + 1).isNotNull() | (F.get(w, F.size(w) - 1) == 0.0))
    size = F.col("_size")

    def joined(*others: Column) -> Column:
        return F.concat_ws("", bare_token(F.get(t, s - 1)), *others)

    # A word of up to three pieces needs no slices.
    one, two, three = F.get(w, s - 1), F.get(w, s), F.get(w, s + 1)
    word = (
        F.when(size == 1, joined())
        .when(size == 2, joined(F.get(t, s)))
        .when(size == 3, joined(F.get(t, s), F.get(t, s + 1)))
        .otherwise(joined(F.slice(t, s + 1, size - 1)))
    )
    total = (
        F.when(size == 1, one)
        .when(size == 2, one + two)
        .when(size == 3, one + two + three)
        .otherwise(F.get("_sums", F.col("_k")))
    )
    return rows.select("func_id", "stmt_id", (F.col("_k") + 1).alias("word_no"), word.alias("word"), (total / size).alias("weight"))


def token_weights(word_rows: DataFrame) -> DataFrame:
    """(token, weight, frequency): every piece of a word carries the word's weight."""
    pieces = exploded(word_rows, ["weight"], camel_pieces(F.col("word")), "token")
    return pieces.groupBy("token").agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("frequency"))


def low_rated_tokens(weights: DataFrame, limit: int = LOW_RATED) -> DataFrame:
    """The ``limit`` tokens of smallest weight; the limit is the operator."""
    return weights.orderBy("weight", "token").limit(limit).select("token")


def bare_token(token: Column) -> Column:
    """Token without one leading space mark."""
    return F.when(token.startswith(SPACE_MARK), F.substr(token, F.lit(2))).otherwise(token)


def lookup(df: DataFrame, weights: DataFrame, token: str = "token", out: str = "global_weight") -> DataFrame:
    """Add the corpus weight of a token, 0.0 where unknown.

    The dictionary grows with the corpus, so the join side is chosen from its measured size.
    """
    side = weights.select(F.col("token").alias("_token"), F.col("weight").alias("_weight"))
    joined = df.join(side, F.col(token) == F.col("_token"), "left")
    return joined.withColumn(out, F.coalesce("_weight", F.lit(0.0))).drop("_token", "_weight")


def statement_weights(df: DataFrame, weights: DataFrame, local_share: float = LOCAL_SHARE) -> DataFrame:
    """(func_id, stmt_id, span_start, tokens, weight) of every statement.

    ``weight`` is the mean over the first run of ``local_share * local + (1 - local_share) * global``.
    The global part is summed per statement from rows of one token, so the lookup moves small rows;
    the token list stays on the statement row.
    """
    spans = statement_spans(df).withColumn("tokens", F.transform("span_tokens", bare_token))
    tokens = exploded(spans, ["func_id", "stmt_id"], F.col("tokens"), "token")
    summed = lookup(tokens, weights).groupBy("func_id", "stmt_id").agg(F.sum("global_weight").alias("_global"))
    local = F.aggregate("span_weights", F.lit(0.0), lambda a, x: a + x)
    total = F.lit(local_share) * local + F.lit(1.0 - local_share) * F.col("_global")
    return spans.join(summed, ["func_id", "stmt_id"]).select(
        "func_id", "stmt_id", "span_start", "tokens", (total / F.size("tokens")).alias("weight")
    )


def statement_text(tokens: Column) -> Column:
    """Printed statement: tokens joined by a space, space marks removed."""
    return F.replace(F.array_join(tokens, " "), F.lit(SPACE_MARK), F.lit(""))


def statement_ranking(statements: DataFrame) -> DataFrame:
    """(func_id, stmt_id, weight, text) by ascending weight, a lone closing brace left out."""
    text = statement_text(F.col("tokens")).alias("text")
    return (
        statements.select("func_id", "stmt_id", "weight", text)
        .where(F.col("text") != "}")
        .orderBy("weight", "func_id", "stmt_id")
    )


def ranking_lines(left: Column, right: Column) -> Column:
    """``left  ||  right``."""
    return F.concat(left.cast("string"), F.lit("  ||  "), right.cast("string"))


def keyword_profile(weights: DataFrame) -> DataFrame:
    """Keywords grouped by frequency: mean weight, first name, repeats, scaled frequency."""
    return (
        weights.where(F.col("token").isin(CPP_KEYWORDS))
        .groupBy("frequency")
        .agg(F.avg("weight").alias("weight"), F.min("token").alias("name"), F.count(F.lit(1)).alias("repeats"))
        .withColumn("x", F.col("frequency") * KEYWORD_SCALE)
    )


def merge_marked(weights: DataFrame) -> DataFrame:
    """Entries that still carry a space mark, merged by token."""
    marked = weights.where(F.col("token").contains(SPACE_MARK))
    return marked.groupBy("token").agg(
        (F.sum(F.col("frequency") * F.col("weight")) / F.sum("frequency")).alias("weight"),
        F.sum("frequency").alias("frequency"),
    )


def cloud_counts(weights: DataFrame, min_frequency: int = CLOUD_MIN_FREQUENCY) -> DataFrame:
    """(token, text, copies): frequent tokens, first character cut, copies by log weight."""
    copies = F.greatest(F.log2(F.col("weight") * CLOUD_SCALE).cast("int"), F.lit(0))
    return weights.where(F.col("frequency") > min_frequency).select(
        "token", F.substr("token", F.lit(2)).alias("text"), copies.alias("copies")
    )
