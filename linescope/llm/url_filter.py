"""URL verdicts by host rules and by a path-template tree with smoothed labelled purity.

Each path is walked down a tree of its host to its end, one segment a level. Digits of a segment become a wildcard at once; a node
with many different children becomes a wildcard node. Sibling templates whose labels do not differ significantly from
those of the rest of their parent are merged with it. A template is blocked where the share of good labels, smoothed by
its parent, its host and the whole table, is below ``PURITY``. Counts come from combinable aggregates per host and
prefix, so a hot host is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm import urls
from linescope.session import materialise

#: (verdict, host, start of the path).
Rule = tuple[str, str, str]

#: Levels that the SQL writes out, which holds for paths up to them; the tree here has no last level.
LEVELS = 4
#: A node with more children than this is variable if its children have fewer than ``CHILD_ROWS`` rows on average.
CHILDREN = 16
CHILD_ROWS = 8
#: Two-sided 5 percent point of the normal distribution, for the merging test.
Z = 1.96
#: Weight of the level above in a smoothed share, in labelled rows.
WEIGHT = 4.0
PURITY = 0.5


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (verdict, rule) of the longest fitting rule, or null."""
    cases = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for verdict, h, p in rules
    ]
    if not cases:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    return F.greatest(*cases) if len(cases) > 1 else cases[0]


def _segments(path: Column) -> Column:
    """Segments with digits generalised."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "*"), "/", -1)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def templates(pages: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``pages`` with ``_parent`` and ``_template``: the path in its host's tree.

    A node with at most ``CHILDREN`` rows has no variable node in or below it, so its rows go to their ends at once; a
    level walks only the rows of larger nodes, and levels go on until no row has a segment left.
    """
    rows = pages.withColumns({"_segments": _segments(F.col(path)), "_prefix": F.lit("")})
    level, walked = 0, []
    while True:
        rows = rows.withColumn("_segment", F.get("_segments", F.lit(level)))
        children = rows.where(F.col("_segment").isNotNull()).groupBy(host, "_prefix", "_segment").agg(F.count(F.lit(1)).alias("_rows"))
        nodes = children.groupBy(host, "_prefix").agg(F.count(F.lit(1)).alias("_children"), F.sum("_rows").alias("_rows"))
        large = nodes.where(F.col("_rows") > CHILDREN).select(
            F.col(host).alias("_h"),
            F.col("_prefix").alias("_p"),
            ((F.col("_children") > CHILDREN) & (F.col("_rows") < F.col("_children") * CHILD_ROWS)).alias("_variable"),
        )
        joined = rows.join(large, (rows[host] == F.col("_h")) & (rows["_prefix"] == F.col("_p")), "left")
        left = F.size("_segments") - level
        step = F.concat("_prefix", F.lit("/"), F.when(F.col("_variable"), F.lit("*")).otherwise(F.col("_segment")))

        def literal(n: Column, at: int = level) -> Column:
            return F.when(n > 0, F.concat("_prefix", F.lit("/"), F.array_join(F.slice("_segments", F.lit(at + 1), n), "/"))).otherwise(
                F.col("_prefix")
            )

        walks = F.col("_variable").isNotNull() & F.col("_segment").isNotNull()
        rows = materialise(
            joined.withColumns(
                {
                    "_parent": F.when(walks, F.col("_prefix")).otherwise(literal(F.greatest(left - 1, F.lit(0)))),
                    "_prefix": F.when(walks, step).otherwise(literal(left)),
                    "_open": walks & (left > 1),
                }
            ).drop("_h", "_p", "_segment", "_variable"),
            "tree",
        )
        walked.append(rows.where(~F.col("_open")))
        rows = rows.where("_open").drop("_parent", "_open")
        if rows.isEmpty():
            break
        level += 1
    done = walked[0]
    for more in walked[1:]:
        done = done.unionByName(more)
    return done.withColumnRenamed("_prefix", "_template").drop("_segments", "_open")


def purity(rows: DataFrame, host: str, label: str) -> DataFrame:
    """(host, _parent, _template, _purity, _merged): smoothed share of good labels of every template."""
    good = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    leaves = materialise(
        rows.groupBy(host, "_parent", "_template").agg(F.sum(good).alias("k"), F.count(label).cast("double").alias("n")), "templates"
    )
    hosts = leaves.groupBy(F.col(host).alias("_h")).agg(F.sum("k").alias("k_host"), F.sum("n").alias("n_host"))
    whole = leaves.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    overall = (whole[0] + 1.0) / (whole[1] + 2.0)
    parents = leaves.groupBy(F.col(host).alias("_hp"), F.col("_parent").alias("_pp")).agg(
        F.sum("k").alias("k_all"), F.sum("n").alias("n_all")
    )
    placed = leaves.join(parents, (leaves[host] == F.col("_hp")) & (leaves["_parent"] == F.col("_pp")))
    k_rest, n_rest = F.col("k_all") - F.col("k"), F.col("n_all") - F.col("n")
    pooled = F.try_divide(F.col("k_all"), F.col("n_all"))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), n_rest)))
    differs = (
        (F.col("n") > 0) & (n_rest > 0) & (spread > 0) & (F.abs(F.try_divide(F.col("k"), F.col("n")) - F.try_divide(k_rest, n_rest)) > spread * Z)
    )
    tested = materialise(placed.withColumn("_merged", ~F.coalesce(F.when((F.col("n") > 0) & (n_rest > 0), differs), F.lit(False))), "siblings")
    merged = tested.where("_merged").groupBy(F.col(host).alias("_hm"), F.col("_parent").alias("_pm")).agg(
        F.sum("k").alias("k_merged"), F.sum("n").alias("n_merged")
    )
    joined = tested.join(merged, (tested[host] == F.col("_hm")) & (tested["_parent"] == F.col("_pm")), "left").join(
        hosts, tested[host] == F.col("_h")
    )
    host_share = (F.col("k_host") + WEIGHT * overall) / (F.col("n_host") + WEIGHT)
    parent_share = (F.col("k_all") + host_share * WEIGHT) / (F.col("n_all") + WEIGHT)
    k = F.when(F.col("_merged"), F.col("k_merged")).otherwise(F.col("k"))
    n = F.when(F.col("_merged"), F.col("n_merged")).otherwise(F.col("n"))
    return joined.select(host, "_parent", "_template", "_merged", ((k + parent_share * WEIGHT) / (n + WEIGHT)).alias("_purity"))


def verdicts(
    pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", label: str = "label", least: float = PURITY
) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity): one row per input row.

    ``label`` holds 1 for good, 0 for bad and null for unknown. A null URL or one without ``://`` has the empty host
    and path, which is a host like any other. The longest fitting rule decides, else the template's purity. Repeated
    rows count as often as they occur. Without labels every purity is 1/2 and nothing is blocked by it. An empty table
    gives no rows. Other columns are ignored, whatever their names; URLs are read whole.
    """
    rows = pages.select(
        F.col(key).alias("_key"),
        urls.host(F.col(url)).alias("host"),
        urls.path(F.col(url)).alias("path"),
        F.col(label).alias("_label"),
    )
    walked = materialise(templates(rows), "walked")
    shares = purity(walked, "host", "_label").select(
        F.col("host").alias("_h"), F.col("_parent").alias("_p"), F.col("_template").alias("_t"), "_purity"
    )
    joined = walked.join(
        shares,
        (walked["host"] == F.col("_h")) & (walked["_parent"] == F.col("_p")) & (walked["_template"] == F.col("_t")),
        "left",
    ).withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("_purity") < least, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"),
        F.col("_template").alias("template"),
        F.col("_purity").alias("purity"),
    )
