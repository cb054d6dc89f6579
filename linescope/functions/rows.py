"""Turning array elements into rows.

A plain ``explode`` makes the optimizer add a filter on the array, which computes a costly array
expression three times, and below any repartitioning of the text. The outer form with a filter on
the produced column computes it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: Sequence[str | Column], array: Column, value: str, pos: str | None = None) -> DataFrame:
    """``keep`` beside one row per element; without ``pos`` NULL elements are left out."""
    made = F.posexplode_outer(array).alias(pos, value) if pos else F.explode_outer(array).alias(value)
    return df.select(*keep, made).where(F.col(pos or value).isNotNull())


def inlined(df: DataFrame, keep: Sequence[str | Column], structs: Column, marker: str) -> DataFrame:
    """``keep`` beside the fields of every struct whose ``marker`` field is not NULL."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(marker).isNotNull())
