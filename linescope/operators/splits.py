"""Splitting, ordering and describing labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linescope.operators.ranking import hash_rank, value_rank
from linescope.session import small_side


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are required but were not found")
    return df


def random_split(df: DataFrame, key: str = "key", train: float = 0.8, valid: float = 0.1, seed: object = 42) -> DataFrame:
    """Exact random split: ``int(train*n)`` rows, ``int(valid*n)`` rows, the remainder."""
    ranked = hash_rank(df, key, seed, rank="_rank", total="_all")
    n_train = F.floor(F.lit(train) * F.col("_all"))
    n_valid = F.floor(F.lit(valid) * F.col("_all"))
    part = (
        F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_valid, "valid").otherwise("test")
    )
    return ranked.withColumn("partition", part).drop("_rank", "_all")


def _quota(counts: DataFrame, label: str, size: str, wanted: str, out: str) -> DataFrame:
    """Largest-remainder share of ``wanted`` rows for each class of ``size`` rows.

    The windows run over one row per class.
    """
    every = Window.partitionBy(F.lit(0))
    exact = F.col(size) / F.sum(size).over(every) * F.col(wanted)
    spread = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(label))
    extra = F.row_number().over(order) <= F.col(wanted) - F.sum("_floor").over(every)
    return spread.withColumn(out, F.col("_floor") + extra.cast("long")).drop("_exact", "_floor")


def stratified_split(
    df: DataFrame, label: str = "severity", key: str = "key", held_out: float = 0.3, test_of_held: float = 0.5, seed: object = 42
) -> DataFrame:
    """Stratified train/valid/test split in two steps, with exact per-class quotas."""
    every = Window.partitionBy(F.lit(0))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    counts = counts.withColumn("_held", F.ceil(F.lit(held_out) * F.sum("_size").over(every))).withColumn(
        "_n_train", F.sum("_size").over(every) - F.col("_held")
    )
    counts = _quota(counts, label, "_size", "_n_train", "_train")
    counts = counts.withColumn("_rest", F.col("_size") - F.col("_train")).withColumn(
        "_n_valid", F.col("_held") - F.ceil(F.lit(test_of_held) * F.col("_held"))
    )
    counts = _quota(counts, label, "_rest", "_n_valid", "_valid").select(label, "_train", "_valid")
    ranked = hash_rank(df, key, seed, part=[label], rank="_rank").join(small_side(counts, "quotas"), label)
    part = (
        F.when(F.col("_rank") < F.col("_train"), "train")
        .when(F.col("_rank") < F.col("_train") + F.col("_valid"), "valid")
        .otherwise("test")
    )
    return ranked.withColumn("partition", part).drop("_rank", "_train", "_valid")


def tag_and_union(parts: dict[str, DataFrame], column: str = "partition") -> DataFrame:
    """Union separate tables, each tagged with its name."""
    tagged = [df.withColumn(column, F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def permutation(df: DataFrame, key: str = "key", seed: object = 42, position: str = "position") -> DataFrame:
    """Seeded row permutation as a 0-based position."""
    return hash_rank(df, key, seed, rank=position)


def class_distribution(df: DataFrame, label: str = "severity", part: str = "partition") -> DataFrame:
    """Rows and share of each class within each partition."""
    counts = df.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(part)))


def fit_labels(df: DataFrame, label: str = "severity") -> DataFrame:
    """Sorted distinct labels with ids 0..k-1, one row per class."""
    classes = df.select(label).where(F.col(label).isNotNull()).distinct()
    return value_rank(classes, label, rank="label_id").withColumn("label_id", F.col("label_id").cast("int"))


def encode_labels(df: DataFrame, labels: DataFrame, label: str = "severity") -> DataFrame:
    """Add ``label_id``; a label not seen at fit time raises."""
    joined = df.join(small_side(labels, "labels"), label, "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label "), F.coalesce(F.col(label).cast("string"), F.lit("NULL"))))
    return joined.withColumn("label_id", F.coalesce(F.col("label_id"), unseen.cast("int")))


def decode_one_hot(df: DataFrame, labels: DataFrame, vector: str, label: str = "severity") -> DataFrame:
    """Label of the largest entry of a one-hot or score vector."""
    position = (F.array_position(F.col(vector), F.array_max(F.col(vector))) - 1).cast("int")
    return df.withColumn("label_id", position).join(small_side(labels, "labels"), "label_id")


def minus_rows(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose ``on`` values do not occur in ``right``."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")
