"""Distance between true and predicted severity vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks and their ordinal scales.
SCORED_TASKS = [
    "cvss2_conf",
    "cvss2_integrity",
    "cvss2_avail",
    "cvss2_accessvect",
    "cvss2_accesscomp",
    "cvss2_auth",
    "cvss2_severity",
]
SCALES = {
    "cvss2_accesscomp": ["LOW", "MEDIUM", "HIGH"],
    "cvss2_severity": ["LOW", "MEDIUM", "HIGH"],
    "cvss2_conf": ["NONE", "PARTIAL", "COMPLETE"],
    "cvss2_avail": ["NONE", "PARTIAL", "COMPLETE"],
    "cvss2_integrity": ["NONE", "PARTIAL", "COMPLETE"],
}
UNKNOWN = "-"


def _partial(task: str, true: Column, pred: Column) -> Column:
    scale = SCALES.get(task)
    if scale is None:
        return F.when(true.eqNullSafe(pred), 0.0).otherwise(1.0)
    steps = F.array(*[F.lit(x) for x in scale])
    i, j = F.array_position(steps, true), F.array_position(steps, pred)
    off_scale = F.raise_error(F.concat(F.lit(f"{task}: value off the scale: "), F.concat_ws(" / ", true, pred)))
    return (
        F.when(true.eqNullSafe(pred) | (true == UNKNOWN) | (pred == UNKNOWN), 0.0)
        .when((i > 0) & (j > 0), F.abs(i - j) / 2.0)
        .otherwise(off_scale.cast("double"))
    )


def prediction_distance(df: DataFrame, extra_tasks: Sequence[str] = (), suffix: str = "-pred") -> DataFrame:
    """Add ``score_abs`` (mismatching tasks) and ``score_partial`` (half a point per step)."""
    absolute, partial = F.lit(0), F.lit(0.0)
    for task in [*SCORED_TASKS, *extra_tasks]:
        true, pred = F.col(f"`{task}`"), F.col(f"`{task}{suffix}`")
        absolute = absolute + (~true.eqNullSafe(pred)).cast("int")
        partial = partial + _partial(task, true, pred)
    return df.withColumn("score_abs", absolute).withColumn("score_partial", partial)
