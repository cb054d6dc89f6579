"""Quality rules with adaptive thresholds: JVM expressions, mergeable quantile sketches, one joined filter.

Measures of a text are one projection. A KLL sketch per language and source holds the distribution of each measure;
sketches merge to the language and to the whole table, which stand in for groups with few rows. A row is rejected
where a measure lies beyond the quartiles of its group by ``SPREAD`` times their distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.text import bind
from linescope.session import materialise

#: Fixed values of the base rules.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
LEAST_WORDS = 50
REPEAT_PERCENT = 50

#: Items that a sketch holds exactly; beyond it ranks are within about 0.3 percent.
SKETCH_K = 1024
#: A group with fewer rows than this takes the thresholds of its language, or else of the table.
GROUP_ROWS = 100
SPREAD = 3.0
#: Smallest distance of the quartiles that counts, for measures that are constant in clean text.
LEAST_SPREAD = {"symbols": 0.1, "capitals": 0.06, "repeats": 0.1, "dup_lines": 0.2, "word_length": 0.6}
#: Measures of which small values are suspicious too.
TWO_SIDED = ("word_length",)
#: Threshold tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def words_of(text: Column) -> Column:
    """Words of the text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice, in n log n."""

    def windows(hashes: Column) -> Column:
        at = F.when(F.size(hashes) >= 3, F.sequence(F.lit(0), F.size(hashes) - 3)).otherwise(F.array().cast("array<int>"))
        return bind(counted, F.transform(at, lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))))

    def counted(made: Column) -> Column:
        # Most texts repeat no window: a hash set tells, and only the others are sorted.
        placed = F.transform(made, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(made)) < F.size(made), bind(repeated, F.array_sort(placed))).otherwise(
            F.lit(0).cast("bigint")
        )

    def repeated(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, k: (F.get(ordered, k + 1)["h"] == x["h"]) | (F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]) & (k > 0),
        )
        return bind(covered, F.array_sort(F.transform(twice, lambda x: x["i"])))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))).cast("bigint"))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)

    return bind(windows, F.transform(words, lambda w: F.xxhash64(w)))


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("bigint")


def measures(text: Column) -> Column:
    """Struct of the base counts and of the ratios that adaptive thresholds judge (null without words)."""
    whole = F.coalesce(text, F.lit(""))

    def counted(words: Column, body: Column, lines: Column) -> Column:
        n = F.size(words).cast("bigint")
        n_lines = F.size(lines)
        return F.struct(
            n.alias("n_words"),
            _without(body, WORD_BREAK).alias("word_chars"),
            F.regexp_count(body, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
            (n_lines - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
            F.regexp_count(body, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
            n_lines.cast("bigint").alias("n_lines"),
        )

    lines = F.transform(
        F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.xxhash64(x)
    )
    return bind(counted, words_of(whole), whole, lines)


def _ratios(m: Column) -> dict[str, Column]:
    n = m["n_words"].cast("double")
    some = m["n_words"] > 0
    return {
        "symbols": F.when(some, m["n_symbols"] / n),
        "capitals": F.when(some, m["n_capitals"] / m["word_chars"]),
        "repeats": F.when(some, m["n_repeat_words"] / n),
        "dup_lines": F.when(some, m["n_dup_lines"] / m["n_lines"]),
        "word_length": F.when(some, m["word_chars"] / n),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * REPEAT_PERCENT)


def _fences(sketches: DataFrame, level: tuple[str, ...]) -> DataFrame:
    """Bounds of every measure per level, from merged sketches."""
    merged = [F.kll_merge_agg_double(f"_s_{x}", SKETCH_K).alias(f"_s_{x}") for x in LEAST_SPREAD]
    grouped = sketches.groupBy(*level).agg(F.sum("_rows").alias("_rows"), *merged)
    out = []
    for x, least in LEAST_SPREAD.items():
        low = F.kll_sketch_get_quantile_double(f"_s_{x}", F.lit(0.25))
        high = F.kll_sketch_get_quantile_double(f"_s_{x}", F.lit(0.75))
        reach = F.greatest(high - low, F.lit(least)) * SPREAD
        out.append((high + reach).alias(f"hi_{x}"))
        if x in TWO_SIDED:
            out.append((low - reach).alias(f"lo_{x}"))
    return grouped.where("_rows > 0").select(*level, "_rows", F.struct(*out).alias("_fence"))


def thresholds(measured: DataFrame, column: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """(_lang, _source, fence): bounds per language and source of the rows that pass the base rules.

    Groups below ``GROUP_ROWS`` such rows take the bounds of their language, languages below it those of the table.
    """
    m = F.col(column)
    passed = measured.where(~base_failed(m)).select(
        F.col(lang).cast("string").alias("_lang"),
        F.col(source).cast("string").alias("_source"),
        *[r.alias(x) for x, r in _ratios(m).items()],
    )
    sketches = materialise(
        passed.groupBy("_lang", "_source").agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.kll_sketch_agg_double(x, SKETCH_K).alias(f"_s_{x}") for x in LEAST_SPREAD],
        ),
        "sketches",
    )
    own = _fences(sketches, ("_lang", "_source")).select("_lang", "_source", F.col("_rows").alias("_n"), F.col("_fence").alias("_own"))
    lang_rows = _fences(sketches, ("_lang",)).select(
        F.col("_lang").alias("_l"), F.col("_rows").alias("_n_lang"), F.col("_fence").alias("_by_lang")
    )
    joined = own.join(lang_rows, own["_lang"].eqNullSafe(lang_rows["_l"]))
    # One row for the whole table; no row, no group.
    whole = _fences(sketches, ()).select("_fence.*")
    values = whole.first() or [None] * len(whole.columns)
    every = F.struct(*[F.lit(v).cast("double").alias(x) for x, v in zip(whole.columns, values, strict=True)])
    fence = (
        F.when(F.col("_n") >= GROUP_ROWS, F.col("_own"))
        .when(F.col("_n_lang") >= GROUP_ROWS, F.col("_by_lang"))
        .otherwise(every)
    )
    return joined.select("_lang", "_source", fence.alias("_fence"))


def judged(measured: DataFrame, bounds: DataFrame, column: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` beside ``_kept`` and ``_broken``, the first adaptive rule that the row breaks."""
    bounds = materialise(bounds, "thresholds")
    side = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds
    on = measured[lang].cast("string").eqNullSafe(side["_lang"]) & measured[source].cast("string").eqNullSafe(side["_source"])
    m, fence = F.col(column), F.col("_fence")
    breaks = []
    for x, r in _ratios(m).items():
        bad = r > fence[f"hi_{x}"]
        if x in TWO_SIDED:
            bad = bad | (r < fence[f"lo_{x}"])
        breaks.append(F.when(bad, F.lit(x)))
    failed = base_failed(m)
    return (
        measured.join(side, on, "left")
        .withColumn("_broken", F.when(failed, F.lit("base")).otherwise(F.coalesce(*breaks)))
        .withColumn("_kept", F.col("_broken").isNull())
        .drop("_lang", "_source", "_fence")
    )


def verdicts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(key, base counts, base_failed, kept, broken): one row per input row.

    A null, empty or blank text has no words and fails the base rules. Null languages and sources are groups of their
    own. Repeated rows are judged alike and count as often as they occur. An empty table gives no rows. Other columns
    are ignored, whatever their names; texts are measured whole.
    """
    rows = docs.select(
        F.col(key).alias("_key"),
        F.col(lang).alias("_in_lang"),
        F.col(source).alias("_in_source"),
        measures(F.col(text).cast("string")).alias("_m"),
    )
    measured = materialise(rows, "measures")
    out = judged(measured, thresholds(measured, "_m", "_in_lang", "_in_source"), "_m", "_in_lang", "_in_source")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(
        F.col("_key").alias(key),
        *[F.col("_m")[x].alias(x) for x in names],
        base_failed(F.col("_m")).alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_broken").alias("broken"),
    )


def kept_rows(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    Cases are treated as in :func:`verdicts`. Rows are measured once and written with their measures; no text
    is shuffled.
    """
    column = _free_name(docs, "_measures")
    if clash := {"_broken", "_kept", "_fence", "_lang", "_source"} & set(docs.columns):
        renamed = docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}" if c in clash else c) for c in docs.columns])
        out = kept_rows(renamed, text, lang, source)
        return out.select(*[F.col(f"`_in_{c}`" if c in clash else f"`{c}`").alias(c) for c in docs.columns])
    measured = materialise(docs.withColumn(column, measures(F.col(text).cast("string"))), "measured")
    bounds = thresholds(measured.select(lang, source, column), column, lang, source)
    return judged(measured, bounds, column, lang, source).where("_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def _free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name
