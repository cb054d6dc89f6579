"""Comparing two groups of results: rank tests and effect size.

Input is long: ``(scenario, side, key, value)`` with side ``A`` or ``B``; rows without a value are left out. Values are counted before
they are ranked, and ranks run over value buckets, so one scenario may hold any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.tails import normal_tail, rank_sum_tail, signed_rank_p
from linescope.operators.ranking import hash_rank, running_distinct, value_rank
from linescope.session import materialise, small_side

# The compared tasks.
TASKS = [
    "cvss2_auth",
    "cvss2_conf",
    "cvss2_accessvect",
    "cvss2_avail",
    "cvss2_accesscomp",
    "cvss2_severity",
    "cvss2_integrity",
]


def _check(method: str) -> None:
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"unknown method {method!r}")


def _is(side: str) -> Column:
    return F.col("side") == side


def _measured(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull() & ~F.isnan("value"))


def with_overall(df: DataFrame) -> DataFrame:
    """Every row once under its scenario and once under ``overall``."""
    return df.withColumn("scenario", F.explode(F.array(F.col("scenario"), F.lit("overall"))))


def group_moments(df: DataFrame) -> DataFrame:
    """(scenario, n_a, n_b, mean_a, mean_b, var_a, var_b) by plain aggregates."""
    a, b = F.when(_is("A"), F.col("value")), F.when(_is("B"), F.col("value"))
    return df.groupBy("scenario").agg(
        F.count(a).alias("n_a"),
        F.count(b).alias("n_b"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("var_a"),
        F.var_samp(b).alias("var_b"),
    )


def cohen_d(df: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """(scenario, cohen_d): absolute mean difference over the pooled deviation."""
    m = moments or group_moments(_measured(df))
    pooled = F.sqrt(
        ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2)
    )
    return m.select("scenario", (F.abs(F.col("mean_a") - F.col("mean_b")) / pooled).alias("cohen_d"))


def mann_whitney(
    df: DataFrame, override_alt: str | None = None, method: str = "asymptotic", moments: DataFrame | None = None
) -> DataFrame:
    """(scenario, alternative, u, z, p) of the Mann-Whitney test.

    ``p`` comes from the normal approximation with tie and continuity correction; with ``method="exact"`` the
    arrangements of scenarios without ties are counted. ``u`` belongs to side A. The alternative is ``greater`` where the
    mean of A is smaller, else ``less``. ``moments`` are those of ``df``, where they are at hand.
    """
    _check(method)
    df = _measured(df)
    counted = df.groupBy("scenario", "value").agg(
        F.sum(_is("A").cast("bigint")).alias("a"), F.sum(_is("B").cast("bigint")).alias("b")
    )
    counted = counted.withColumn("t", F.col("a") + F.col("b"))
    placed = running_distinct(counted, "value", {"t": "before"}, part=["scenario"])
    t = F.col("t").cast("double")
    rank = F.col("before") + (t + 1.0) / 2.0
    sums = placed.groupBy("scenario").agg(
        F.sum(F.col("a") * rank).alias("r_a"), F.sum(t * t * t - t).alias("ties")
    )
    joined = sums.join(moments or group_moments(df), "scenario")
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    u = F.col("r_a") - n_a * (n_a + 1.0) / 2.0
    alternative = F.lit(override_alt) if override_alt else F.when(F.col("mean_a") < F.col("mean_b"), "greater").otherwise("less")
    rows = joined.select("scenario", alternative.alias("alternative"), u.alias("u"), n_a.alias("na"), n_b.alias("nb"), n.alias("n"), "ties")
    product = F.col("na") * F.col("nb")
    other = product - F.col("u")
    tested = (
        F.when(F.col("alternative") == "greater", F.col("u"))
        .when(F.col("alternative") == "less", other)
        .otherwise(F.greatest(F.col("u"), other))
    )
    deviation = F.sqrt(product / 12.0 * (F.col("n") + 1.0 - F.col("ties") / (F.col("n") * (F.col("n") - 1.0))))
    rows = rows.withColumn("tested", tested).withColumn("z", (F.col("tested") - product / 2.0 - 0.5) / F.nullif(deviation, F.lit(0.0)))
    z = F.col("z")
    p = normal_tail(z) if method == "asymptotic" else rank_sum_tail(z, *(F.col(c) for c in ("tested", "na", "nb", "ties")))
    p = F.when(F.col("alternative") == "two-sided", F.least(2.0 * p, F.lit(1.0))).otherwise(p)
    return rows.withColumn("p", p).select("scenario", "alternative", "u", "z", "p")


def paired(df: DataFrame, seed: object = 42, moments: DataFrame | None = None) -> DataFrame:
    """(scenario, a, b): sides cut to equal size and paired by position.

    The larger side is sampled in md5 order; a side that is not larger keeps its key order.
    """
    df = _measured(df)
    sizes = (moments or group_moments(df)).select("scenario", "n_a", "n_b")
    own = F.when(_is("A"), F.col("n_a")).otherwise(F.col("n_b"))
    other = F.when(_is("A"), F.col("n_b")).otherwise(F.col("n_a"))
    sized = df.join(small_side(sizes, "sizes"), "scenario").withColumn("_larger", own > other)
    part = ["scenario", "side"]
    sampled = hash_rank(sized.where("_larger"), "key", seed, part=part, rank="at")
    plain = value_rank(sized.where("not _larger"), "key", part=part, rank="at")
    rows = sampled.unionByName(plain).where(F.col("at") < F.least("n_a", "n_b"))
    return rows.groupBy("scenario", "at").agg(
        F.max(F.when(_is("A"), F.col("value"))).alias("a"), F.max(F.when(_is("B"), F.col("value"))).alias("b")
    )


def wilcoxon(df: DataFrame, seed: object = 42, method: str = "asymptotic", moments: DataFrame | None = None) -> DataFrame:
    """(scenario, n, w, z, p) of the signed-rank test, two-sided, zero differences dropped.

    ``p`` is the normal approximation; with ``method="exact"`` scenarios without ties and zeros are counted.
    """
    _check(method)
    d = F.col("a") - F.col("b")
    differences = paired(df, seed, moments).select("scenario", d.alias("d"))
    zero = F.col("size") == 0
    # Zero differences have the smallest size, so giving them no weight leaves the ranks above them whole.
    counted = differences.groupBy("scenario", F.abs("d").alias("size")).agg(
        F.sum((F.col("d") > 0).cast("bigint")).alias("up"),
        F.sum((F.col("d") < 0).cast("bigint")).alias("down"),
        F.sum((F.col("d") == 0).cast("bigint")).alias("zeros"),
    )
    counted = counted.withColumn("t", F.when(zero, F.lit(0).cast("bigint")).otherwise(F.col("up") + F.col("down")))
    placed = running_distinct(counted, "size", {"t": "before"}, part=["scenario"])
    t = F.col("t").cast("double")
    rank = F.col("before") + (t + 1.0) / 2.0
    sums = placed.groupBy("scenario").agg(
        F.sum("t").alias("n"),
        F.sum(F.col("up") * rank).alias("r_up"),
        F.sum(F.col("down") * rank).alias("r_down"),
        F.sum(t * t * t - t).alias("ties"),
        F.sum("zeros").alias("zeros"),
    )
    n = F.col("n").cast("double")
    w = F.least("r_up", "r_down")
    deviation = F.sqrt((n * (n + 1.0) * (2.0 * n + 1.0) - 0.5 * F.col("ties")) / 24.0)
    z = (w - n * (n + 1.0) / 4.0) / F.nullif(deviation, F.lit(0.0))
    rows = sums.select("scenario", "n", w.alias("w"), z.alias("z"), "ties", "zeros")
    columns = [F.col(c) for c in ("z", "w", "n", "ties", "zeros")]
    p = 2.0 * normal_tail(F.abs("z")) if method == "asymptotic" else signed_rank_p(*columns)
    return rows.withColumn("p", p).drop("ties", "zeros")


def _tests(rows: DataFrame, override_alt: str | None) -> DataFrame:
    """(scenario, mean_a, mean_b, mwyu, cohen_d, wilcoxon, n_a, n_b); the moments are taken once, a row a scenario."""
    rows = _measured(rows)
    moments = materialise(group_moments(rows), "moments")
    u = mann_whitney(rows, override_alt, moments=moments).select("scenario", F.col("p").alias("mwyu"))
    w = wilcoxon(rows, moments=moments).select("scenario", F.col("p").alias("wilcoxon"))
    joined = moments.join(u, "scenario", "left").join(cohen_d(rows, moments), "scenario", "left").join(w, "scenario", "left")
    return joined.select("scenario", "mean_a", "mean_b", "mwyu", "cohen_d", "wilcoxon", "n_a", "n_b")


def compare(df: DataFrame, a: str = "A", b: str = "B", extra_tasks: tuple[str, ...] = (), override_alt: str | None = None) -> DataFrame:
    """One row per task and ``overall``: means, lengths, rank tests and effect size of one metric.

    The raw values stay in the input, which is their long form; they are never collected.
    """
    tasks = [*TASKS, *extra_tasks, "overall"]
    tested = _tests(with_overall(df).where(F.col("scenario").isin(tasks)), override_alt)
    return tested.select(
        "scenario", F.lit(a).alias("A"), F.lit(b).alias("B"), "mean_a", "mean_b", "mwyu", "cohen_d", "wilcoxon", "n_a", "n_b"
    )


def compare_metrics(
    df: DataFrame,
    metrics: tuple[str, ...] = ("mcc", "f1"),
    a: str = "A",
    b: str = "B",
    extra_tasks: tuple[str, ...] = (),
    override_alt: str | None = None,
) -> DataFrame:
    """One row per task and ``overall``, with the columns of ``compare`` once for each metric and named after it.

    ``df`` is (scenario, side, key) with one column a metric. Every metric of a task is a group of its own, so all are
    tested in the same jobs; a task without a value of one metric has nulls there.
    """
    tasks = [*TASKS, *extra_tasks, "overall"]
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = with_overall(df).where(F.col("scenario").isin(tasks)).select("scenario", "side", "key", F.inline(values))
    tested = _tests(long.withColumn("scenario", F.to_json(F.array("metric", "scenario"))).drop("metric"), override_alt)
    parts = F.from_json("scenario", "array<string>")
    named = {
        "mean_A": "mean_a", "mean_B": "mean_b", "mwyu": "mwyu", "cohend": "cohen_d", "wilcoxon": "wilcoxon", "n_A": "n_a", "n_B": "n_b",
    }
    return (
        tested.select("*", parts[0].alias("metric"), parts[1].alias("task"))
        .groupBy(F.col("task").alias("scenario"), F.lit(a).alias("A"), F.lit(b).alias("B"))
        .agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{out}_{m}") for m in metrics for out, c in named.items()])
    )
