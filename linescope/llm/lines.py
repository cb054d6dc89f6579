"""Removal of lines that spread over many sites.

Line hashes are counted first: a line in fewer rows than the threshold, or in one site, cannot reach it. The others
get HyperLogLog sketches of their sites by one aggregation; lines whose estimate lies near the threshold are counted
exactly. A line that reaches it is boilerplate if it stands beside different lines in enough of its documents, or if it
is part of a block that does: neighbouring lines that all spread are one block, with the lines around the block as its
context. Blank lines are no neighbours. Lines of copied documents stand beside the same lines each time and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.functions.rows import inlined
from linescope.functions.text import bind
from linescope.session import materialise

MIN_SITES = 5
#: Distinct contexts for each document that holds the line or block, at least.
CONTEXT_SHARE = 0.2
SKETCH_LG_K = 12
#: Relative distance from a threshold within which an estimate is replaced by the exact count: five standard errors.
NEAR = 5 * 1.04 / 2 ** (SKETCH_LG_K / 2)
BLANK = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _line_hash(line: Column) -> Column:
    """Two hashes of the trimmed line; null for a blank one."""
    return bind(
        lambda t: F.when(t != "", F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))), _trimmed(line)
    )


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(site, t0, t1, place, a, b, before, after): every line that is not blank, with its site, text, number among the
    lines that are not blank, and the lines around it (0 at an end)."""

    def placed(hashes: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(hashes, i - 1)["a"])
            after = F.get(hashes, i + 1)["a"]
            return F.struct(
                i.alias("place"),
                h["a"].alias("a"),
                h["b"].alias("b"),
                F.coalesce(before, F.lit(0)).alias("before"),
                F.coalesce(after, F.lit(0)).alias("after"),
            )

        return F.transform(hashes, one)

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = [
        F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"),
        F.xxhash64(whole).alias("t0"),
        F.xxhash64(F.lit(1), whole).alias("t1"),
    ]
    hashes = F.filter(F.transform(_lines(whole), _line_hash), lambda h: h.isNotNull())
    return inlined(docs, keep, bind(placed, hashes), "a")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, n_rows, n_sites): hashes of the lines to remove. ``n_sites`` is exact near the threshold."""
    return _spread(materialise(_occurrences(docs, text, site), "lines"), min_sites)


def _wide(found: DataFrame, min_sites: int) -> DataFrame:
    """(a, b, n_rows, n_sites): lines on enough sites."""
    counted = found.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("site").alias("lo"), F.max("site").alias("hi")
    )
    wide = counted.where((F.col("n_rows") >= min_sites) & (F.col("lo") != F.col("hi"))).select("a", "b")
    sketched = found.join(wide, ["a", "b"], "left_semi").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_LG_K)).alias("n_sites")
    )
    estimates = materialise(
        sketched.where(F.col("n_sites") >= min_sites * (1 - NEAR)).withColumn(
            "near", F.abs(F.col("n_sites") - min_sites) <= NEAR * min_sites
        ),
        "sites",
    )
    again = found.join(estimates.where("near").select("a", "b"), ["a", "b"], "left_semi")
    exact = again.groupBy("a", "b", "site").agg(F.count(F.lit(1)).alias("n")).groupBy("a", "b").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_sites")
    )
    sure = estimates.where(~F.col("near")).select("a", "b", "n_rows", "n_sites")
    return sure.union(exact).where(F.col("n_sites") >= min_sites)


def _varied(units: DataFrame, copies: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """(a, b): units with enough distinct contexts for their documents; a document gives a unit one context."""
    once = units.groupBy(a, b, "t0", "t1").agg(F.min(F.xxhash64("before", "after")).alias("context"))
    contexts = once.join(copies, ["t0", "t1"]).groupBy(a, b, "context").agg(F.sum("n").alias("n"))
    counted = contexts.groupBy(a, b).agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_contexts"))
    return counted.where(F.col("n_contexts") >= F.greatest(F.col("n_docs") * CONTEXT_SHARE, F.lit(float(least)))).select(a, b)


def _spread(found: DataFrame, min_sites: int) -> DataFrame:
    wide = materialise(_wide(found, min_sites), "wide")
    # Equal texts have equal rows here; their documents are counted at their first lines.
    held = materialise(
        found.join(wide.select("a", "b"), ["a", "b"], "left_semi").select("t0", "t1", "place", "a", "b", "before", "after").distinct(),
        "spread",
    )
    firsts = found.where("place = 0")
    copies = firsts.groupBy("t0", "t1").agg(F.count(F.lit(1)).alias("n"))
    lines = _varied(held, copies, "a", "b", 2)

    # Blocks: runs of spread lines within a text.
    order = Window.partitionBy("t0", "t1").orderBy("place")
    runs = held.withColumn("run", F.col("place") - F.row_number().over(order)).groupBy("t0", "t1", "run").agg(
        F.array_sort(F.collect_list(F.struct("place", "a", "b", "before", "after"))).alias("rows")
    )
    blocks = materialise(
        runs.select(
            "t0",
            "t1",
            F.transform("rows", lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))).alias("lines"),
            F.get("rows", F.lit(0))["before"].alias("before"),
            F.element_at("rows", -1)["after"].alias("after"),
        ).withColumns({"p": F.xxhash64("lines"), "q": F.xxhash64(F.lit(1), "lines")}),
        "blocks",
    )
    # A block is on enough sites, beside different lines on as many; near copies give it few contexts.
    on = blocks.select("p", "q", "t0", "t1").distinct().join(firsts.select("t0", "t1", "site").distinct(), ["t0", "t1"])
    sites = on.select("p", "q", "site").distinct().groupBy("p", "q").agg(F.count(F.lit(1)).alias("n_sites"))
    good = _varied(blocks, copies, "p", "q", min_sites).join(sites.where(F.col("n_sites") >= min_sites), ["p", "q"], "left_semi")
    parts = blocks.join(good, ["p", "q"], "left_semi").select(F.inline("lines"))
    return wide.join(lines.union(parts).distinct(), ["a", "b"], "left_semi")


def without_boilerplate(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, removed: str | None = None
) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``; other columns and the row count stay.

    ``removed`` names an optional column for the number of lines taken out. A null text stays null; a text that loses
    all lines is empty. Blank lines are never boilerplate. A null site is one site. Repeated rows and copies count for
    the sites they stand on but give one context; a line that a document repeats counts once. Lines are compared without white space at their ends, whole.
    An empty table gives an empty table. Extra columns may have any name.
    """
    found = materialise(_occurrences(docs, text, site), "lines")
    marked = materialise(_spread(found, min_sites), "boilerplate")
    # One row per text: its lines to remove. Texts are found again by hash, so keys may be null or repeated.
    hits = (
        found.join(marked.select("a", "b"), ["a", "b"])
        .select("t0", "t1", "a")
        .distinct()
        .groupBy("t0", "t1")
        .agg(F.collect_list("a").alias("bad"))
    )
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(whole).alias("t0"),
        F.xxhash64(F.lit(1), whole).alias("t1"),
    )
    joined = held.join(hits, ["t0", "t1"], "left")
    body = F.col("row")[text].cast("string")

    def kept(lines: Column, bad: Column) -> Column:
        return F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bad, _line_hash(x)["a"]), F.lit(False)))

    lines = bind(kept, _lines(body), F.col("bad"))
    cut = joined.select("row", "bad", F.when(F.col("bad").isNotNull() & body.isNotNull(), lines).alias("left"))
    out = [
        (F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(body) if c == text else F.col("row")[c]).alias(c)
        for c in docs.columns
    ]
    if removed:
        n = F.size(_lines(body)) - F.size("left")
        out.append(F.when(F.col("left").isNotNull(), n).otherwise(0).cast("bigint").alias(removed))
    return cut.select(*out)
