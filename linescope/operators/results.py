"""Experiment plans and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.session import small_side

RESULT_KEYS = ["problem", "granularity", "scope", "feature", "classifier", "parameters"]

# Parameter lists per classifier, and the classifiers run by default.
GRID = {
    "lr": [["0.01", "0.1", "1", "10", "100"]],
    "svm": [["0.01", "0.1", "1", "10", "100"]],
    "knn": [["5", "11", "31", "51"], ["uniform", "distance"], ["1", "2"]],
    "rf": [["100", "200", "300", "400", "500"], ["100", "200", "300"]],
    "xgb": [["100", "200", "300", "400", "500"], ["100", "200", "300"]],
    "lgbm": [["100", "200", "300", "400", "500"], ["100", "200", "300"]],
}
ACTIVE = ["svm", "lr"]

# Metric names, and the overall columns that hold them.
METRICS = ["acc", "rec", "prec", "f1", "gmean", "mcc", "auc"]
OVERALL = {
    "accuracy": "acc",
    "precision": "prec",
    "recall": "rec",
    "f1-score": "f1",
    "gmean": "gmean",
    "mcc": "mcc",
    "auc": "auc",
}


def grid(models: Sequence[str] = ACTIVE) -> list[tuple[str, str]]:
    """(classifier, parameters) for every combination, parameters joined by ``-``."""
    return [(m, "-".join(p)) for m in models for p in product(*GRID[m])]


def plan_experiments(experiments: DataFrame, models: Sequence[str] = ACTIVE) -> DataFrame:
    """One row per planned fit: every experiment with every grid entry."""
    entries = F.array(*[F.struct(F.lit(m).alias("classifier"), F.lit(p).alias("parameters")) for m, p in grid(models)])
    return experiments.select("*", F.inline(entries))


def average_results(df: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Mean of every metric over repeats."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in df.columns if c not in keys])


def best_results(
    df: DataFrame, group: Sequence[str] = ("problem", "granularity", "scope"), metric: str = "val_mcc", keys: Sequence[str] = RESULT_KEYS
) -> DataFrame:
    """Row of the largest metric per group, the smallest keys on ties; rows without the metric never win.

    A group in which no row has the metric has no best row.
    """
    measured = df.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    rest = [c for c in df.columns if c not in group]
    order = F.struct((-F.col(metric)).alias("m"), *[k for k in keys if k not in group])
    return measured.groupBy(*group).agg(F.min_by(F.struct(*rest), order).alias("_best")).select(*group, "_best.*")


def best_parameters(df: DataFrame, metric: str = "val_mcc") -> DataFrame:
    """All rows of the parameter with the largest positive mean metric, per classifier."""
    means = df.groupBy("classifier", "parameters").agg(F.avg(metric).alias("_mean")).where(F.col("_mean") > 0)
    winner = means.groupBy("classifier").agg(
        F.min_by("parameters", F.struct((-F.col("_mean")).alias("m"), F.col("parameters"))).alias("parameters")
    )
    return df.join(small_side(winner, "winners"), ["classifier", "parameters"], "left_semi")


def multitask_to_long(df: DataFrame, avg: bool = True, ids: Sequence[str] = ("run", "set", "fold")) -> DataFrame:
    """Wide multitask results to one row per scenario; a projection without shuffle.

    Overall columns form the scenario ``multitask``, ``<task>_<metric>`` columns the scenario
    ``<task>``, ``<x>_time`` columns are carried along as ``time_<x>``. A metric a scenario does
    not have is NULL. ``avg`` takes the means by scenario.
    """
    found: dict[str, dict[str, str]] = {}
    times: dict[str, str] = {}
    for c in df.columns:
        if c in ids:
            continue
        if c in OVERALL:
            found.setdefault("multitask", {})[OVERALL[c]] = c
            continue
        task, _, metric = c.rpartition("_")
        if not task:
            continue
        if metric == "time":
            times[c] = f"time_{task}"
        elif metric in METRICS:
            found.setdefault(task, {})[metric] = c
        else:
            raise ValueError(f"column {c!r} does not end in a known metric")

    def cell(task: str, metric: str) -> Column:
        source = found[task].get(metric)
        return (F.col(f"`{source}`").cast("double") if source else F.lit(None).cast("double")).alias(metric)

    rows = F.array(*[F.struct(F.lit(t).alias("scenario"), *[cell(t, m) for m in METRICS]) for t in sorted(found)])
    carried = [F.col(c).alias(n) for c, n in times.items()]
    out = df.select(*ids, *carried, F.inline(rows))
    if not avg:
        return out
    return out.groupBy("scenario").agg(*[F.avg(c).alias(c) for c in [*times.values(), *METRICS]])


def summarise(df: DataFrame, how: str) -> DataFrame:
    """Mean or sum of every numeric column of the whole table."""
    if how not in ("mean", "sum"):
        raise ValueError("how must be 'mean' or 'sum'")
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "float", "double", "short", "byte")]
    fn = F.avg if how == "mean" else F.sum
    return df.agg(*[fn(c).alias(c) for c in numeric])
