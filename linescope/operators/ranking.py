"""Exact ranks and running totals over whole tables without a one-task window.

Rows are cut into buckets, buckets are counted, and only the bucket counts (a fixed number per
partition value) pass through one window. The row window then runs per bucket, so one hot
partition value is spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.session import materialise

HEX_DIGITS = 3  # 4096 hash buckets
SAMPLED = 4096  # strings that cut points are taken from


def seeded_hash(seed: object, *cols: Column) -> Column:
    """md5 of seed and key columns: a reproducible random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def _before(part: Sequence[str], bucket: str) -> Window:
    spec = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    return spec.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)


def _ranked(df: DataFrame, part: Sequence[str], order: Sequence[Column], rank: str, total: str | None) -> DataFrame:
    counts = df.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        *part,
        "_bucket",
        F.coalesce(F.sum("_n").over(_before(part, "_bucket")), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*part, "_bucket").orderBy(*order)
    out = df.join(offsets, [*part, "_bucket"]).withColumn(
        rank, F.col("_offset") + F.row_number().over(inside) - 1
    )
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_offset", "_total")


def hash_rank(
    df: DataFrame,
    key: str,
    seed: object = 42,
    part: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """0-based position of every row in md5 order of ``(seed, key)``, per ``part``."""
    hashed = df.withColumn("_hash", seeded_hash(seed, F.col(key))).withColumn(
        "_bucket", F.substring("_hash", 1, HEX_DIGITS)
    )
    return _ranked(hashed, part, [F.col("_hash"), F.col(key)], rank, total).drop("_hash")


def value_buckets(df: DataFrame, col: str, buckets: int = 256) -> DataFrame:
    """Add ``_bucket``, an order-preserving cut of ``col`` into roughly equal parts.

    The cut points (at most ``buckets`` doubles) are computed once and become literals, so every
    branch of the plan and every retried task sees the same buckets.
    """
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(col, probs, 1.0 / (2 * buckets))))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol="_bucket", handleInvalid="keep").transform(df)


def string_buckets(df: DataFrame, col: str, buckets: int = 256) -> DataFrame:
    """Add ``_bucket``, an order-preserving cut of a text column into roughly equal parts.

    The cut points are quantiles of the ``SAMPLED`` strings with the smallest hashes. They only balance the buckets:
    any cut points give the same ranks.
    """
    drawn = df.select(F.col(col).alias("s")).where(F.col(col).isNotNull()).orderBy(F.xxhash64(col)).limit(SAMPLED)
    found = sorted({r["s"] for r in drawn.collect()}, key=lambda s: s.encode())
    cuts = [found[i * len(found) // buckets] for i in range(1, buckets)] if len(found) >= buckets else found
    steps = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + steps] for i in range(0, len(cuts), steps)]
    if not groups:
        return df.withColumn("_bucket", F.lit(0))
    # The first of every group is compared first, then only the group found.
    value = F.col(col)
    at = sum((F.coalesce(value >= g[0], F.lit(False)).cast("int") for g in groups), F.lit(0))
    table = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    inside = F.size(F.filter(F.get(table, at - 1), lambda c: c <= value))
    return df.withColumn("_bucket", F.when(at == 0, 0).otherwise((at - 1) * steps + inside))


def value_rank(
    df: DataFrame,
    order: str,
    ties: Sequence[str] = (),
    part: Sequence[str] = (),
    rank: str = "rank",
    buckets: int = 256,
) -> DataFrame:
    """0-based position of every row by ``order`` (number or text), then ``ties``.

    Meant for tables with few equal ``order`` values; count a repeated value first.
    """
    is_text = dict(df.dtypes)[order] == "string"
    if is_text:
        cut = string_buckets(df, order, buckets)
    else:
        cut = value_buckets(df.withColumn("_key", F.col(order).cast("double")), "_key", buckets)
    return _ranked(cut, part, [F.col(order), *[F.col(t) for t in ties]], rank, None).drop("_key")


def running_distinct(
    df: DataFrame, order: str, sums: dict[str, str], part: Sequence[str] = (), buckets: int = 256
) -> DataFrame:
    """Totals over all smaller ``order`` values, for a table with one row per ``(part, order)``.

    The table is written once: the cut points and both branches read it.
    """
    df = materialise(df, "values")
    cut = value_buckets(df.withColumn("_key", F.col(order).cast("double")), "_key", buckets)
    bucket_sums = cut.groupBy(*part, "_bucket").agg(*[F.sum(c).alias(f"_b_{c}") for c in sums])
    offsets = bucket_sums.select(
        *part,
        "_bucket",
        *[F.coalesce(F.sum(f"_b_{c}").over(_before(part, "_bucket")), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    inside = Window.partitionBy(*part, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(offsets, [*part, "_bucket"])
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_key", "_bucket", *[f"_o_{c}" for c in sums])


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    tie_key: str,
    part: Sequence[str] = (),
    seed: object = 42,
    buckets: int = 256,
) -> DataFrame:
    """Add the total of each column over all earlier rows in ``order``, per ``part``.

    ``sums`` maps a source column to the name of its running total; the own row is left out. Rows
    of equal ``order`` follow the md5 of ``(seed, tie_key)``. Equal values are summed before the
    value buckets and cut by hash behind them, so neither a hot partition nor a hot value meets
    one task.
    """
    hashed = df.withColumn("_hash", seeded_hash(seed, F.col(tie_key))).withColumn("_cell", F.substring("_hash", 1, 2))
    group = [*part, order]
    cells = hashed.groupBy(*group, "_cell").agg(*[F.sum(c).alias(f"_c_{c}") for c in sums])
    values = cells.groupBy(*group).agg(*[F.sum(f"_c_{c}").alias(f"_v_{c}") for c in sums])
    value_offsets = running_distinct(values, order, {f"_v_{c}": f"_p_{c}" for c in sums}, part, buckets).select(
        *group, *[f"_p_{c}" for c in sums]
    )
    in_value = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_offsets = cells.join(value_offsets, group).select(
        *group,
        "_cell",
        *[(F.col(f"_p_{c}") + F.coalesce(F.sum(f"_c_{c}").over(in_value), F.lit(0))).alias(f"_q_{c}") for c in sums],
    )
    in_cell = (
        Window.partitionBy(*group, "_cell").orderBy("_hash", tie_key).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = hashed.join(cell_offsets, [*group, "_cell"])
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"_q_{c}") + F.coalesce(F.sum(c).over(in_cell), F.lit(0)))
    return out.drop("_hash", "_cell", *[f"_q_{c}" for c in sums])
