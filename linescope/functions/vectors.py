"""Column expressions over numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """Array from a vector printed as ``[0.1, 0.2]``; NULL where the text is not a list."""
    return F.from_json(text, "array<double>")


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
