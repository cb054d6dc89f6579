"""Exact k nearest neighbours.

The labelled train rows are sent to every worker in blocks of bounded size, in the order of their keys; test rows stream
past each block and never move. What is near in one block meets what is near in the others, at most k rows a block for
each test row. One block is the usual case, and any number gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of train vectors that are sent at a time, and rows that one packet of them holds.
BLOCK_BYTES = 64 << 20
PACKET_ROWS = 1024
#: Numbers in one difference tensor.
BLOCK = 1 << 22
DIGITS = 9


def _distances(points: np.ndarray, rows: np.ndarray, norm: int) -> np.ndarray:
    gap = rows[:, None, :] - points[None, :, :]
    far = np.abs(gap).sum(axis=2) if norm == 1 else np.sqrt((gap * gap).sum(axis=2))
    return np.round(far, DIGITS)


def _closest(far: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest, earlier places first on ties."""
    if k < len(far):
        near = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
    else:
        near = np.arange(len(far))
    return near[np.argsort(far[near], kind="stable")][:k]


def _near_rows(points: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """For every row the places of all points that can be among its ``k`` nearest by Euclidean distance.

    Squares of distances come from one matrix product; what lies within its rounding error and within the last digit that
    is compared stays in.
    """
    own, other = (rows * rows).sum(axis=1), (points * points).sum(axis=1)
    square = own[:, None] + other - 2 * (rows @ points.T)
    if k >= len(points) or not np.isfinite(square).all():
        return [np.arange(len(points))] * len(rows)
    slip = 8 * (points.shape[1] + 8) * np.finfo(float).eps * (own + other.max())
    last = np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0)
    limit = (np.sqrt(last + slip) + 2 * 10.0**-DIGITS) ** 2 + slip
    return [np.flatnonzero(far <= most) for far, most in zip(square, limit, strict=True)]


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, labels and the vectors' bytes of up to ``PACKET_ROWS`` rows as one row."""
    for batch in batches:
        for first in range(0, batch.num_rows, PACKET_ROWS):
            part = batch.slice(first, PACKET_ROWS)
            values = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in (pa.concat_arrays([part.column(i)]) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([values.tobytes()], pa.binary())], ["keys", "labels", "values"])


def _blocks(packets: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, keys, labels) of about ``size`` bytes."""
    held, total = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.array([k for r in held for k in r["keys"]], object)
        points = np.frombuffer(b"".join(bytes(r["values"]) for r in held)).reshape(len(keys), -1)
        return points, keys, np.concatenate([np.array(r["labels"]) for r in held])

    for r in packets.toLocalIterator():
        if held and total + len(r["values"]) > size:
            yield joined()
            held, total = [], 0
        held.append(r)
        total += len(r["values"])
    if held:
        yield joined()


def nearest(
    train: DataFrame, test: DataFrame, k: int, norm: int = 2, block_bytes: int = BLOCK_BYTES, block: int = BLOCK
) -> DataFrame:
    """(key, neighbour, label, distance, place) for train ``(key, label, vector)``, test ``(key, vector)``.

    Distances are compared at nine digits, ties go to the smaller train key. Keys may have any type; without train rows
    nothing is near. Blocks of ``block_bytes`` pass through the driver one at a time.
    """
    spark = train.sparkSession
    held = train.select("key", F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = test.select("key", F.col("vector").cast("array<double>").alias("vector"))
    key, neighbour = (d.schema["key"].dataType.simpleString() for d in (test, train))
    schema = f"key {key}, neighbour {neighbour}, label int, distance double, place int"
    packets = held.orderBy("key").mapInArrow(_packets, f"keys array<{neighbour}>, labels array<int>, values binary")
    parts = [rows.mapInPandas(_near(spark.sparkContext.broadcast(sent), k, norm, block), schema) for sent in _blocks(packets, block_bytes)]
    if not parts:
        return spark.createDataFrame([], schema)
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    order = Window.partitionBy("key").orderBy("distance", "neighbour")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _near(sent, k: int, norm: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, names, labels = sent.value
        # The differences of all dimensions are held at once, of the product only the squares.
        step = max(1, block // max(1, places.size if norm == 1 else len(places)))
        for batch in batches:
            for first in range(0, len(batch), step):
                part = batch.iloc[first : first + step]
                rows = np.stack(part["vector"].to_list())
                if norm == 1:
                    far = _distances(places, rows, norm)
                    best = [_closest(row, k) for row in far]
                    gaps = [row[b] for row, b in zip(far, best, strict=True)]
                else:
                    best, gaps = [], []
                    for row, near in zip(rows, _near_rows(places, rows, k), strict=True):
                        far = _distances(places[near], row[None], norm)[0]
                        found = _closest(far, k)
                        best.append(near[found])
                        gaps.append(far[found])
                size = len(best[0])
                flat = np.concatenate(best)
                yield pd.DataFrame(
                    {
                        "key": np.repeat(part["key"].to_numpy(), size),
                        "neighbour": names[flat],
                        "label": labels[flat],
                        "distance": np.concatenate(gaps),
                        "place": np.tile(np.arange(1, size + 1), len(part)),
                    }
                )

    return run


def classify(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """(key, prediction) by a vote of the neighbours, the smaller label on ties.

    ``distance`` weighs by 1/d; where a neighbour has distance 0 only such neighbours vote.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'")
    zero = F.col("distance") == 0.0
    if weights == "distance":
        near = F.when(~zero, F.lit(1.0) / F.nullif(F.col("distance"), F.lit(0.0)))
        exact = F.when(zero, 1).otherwise(0)
    else:
        near, exact = F.lit(1.0), F.lit(0)
    votes = neighbours.groupBy("key", "label").agg(
        F.sum(exact).alias("exact"), F.round(F.coalesce(F.sum(near), F.lit(0.0)), DIGITS).alias("near")
    )
    strength = F.struct(
        F.col("exact"), F.when(F.col("exact") > 0, 0.0).otherwise(F.col("near")).alias("near"), -F.col("label")
    )
    return votes.groupBy("key").agg(F.max_by("label", strength).alias("prediction"))
