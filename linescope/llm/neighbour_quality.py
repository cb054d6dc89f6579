"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is the bag of its word shapes (runs of lower-case, capitals, digits and each mark) and of words that repeat the
one before, hashed to ``DIMENSIONS`` columns, as square roots of relative frequencies times idf over all documents.
A truncated SVD of the labelled rows gives the space. The labelled vectors are broadcast: they are at most
``LABELLED`` rows of ``RANK`` numbers. Every document is compared with all of them by blocked matrix products, and the
labels of the ``NEIGHBOURS`` nearest vote with their similarities as weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.words import slices, words
from linescope.session import materialise

DIMENSIONS = 1024
RANK = 64
#: Bound of the labelled sample: texts with the smallest hashes. 4096 * 64 * 4 bytes = 1 MB are broadcast.
LABELLED = 4096
NEIGHBOURS = 15
#: Power of the similarity that weighs a vote, and weight of the mean label beside the votes.
SHARPNESS = 8
PRIOR_WEIGHT = 1e-3
THRESHOLD = 0.7
ROWS = 1024

#: Shape of a byte: one letter for a class, marks for themselves, white space as it is.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("Q")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[128:] = ord("a")


def shape_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, DIMENSIONS) occurrences of hashed shapes and of repeated words."""
    rows = len(at) - 1
    plain = words(data, at)
    count = np.diff(plain.first)
    row = np.repeat(np.arange(rows), count)
    shape = SHAPE[data]
    first = np.ones(len(data), bool)
    first[1:] = shape[1:] != shape[:-1]
    first[at[:-1][at[:-1] < len(data)]] = True
    first[plain.starts] = True
    short = shape[first]
    cuts = np.concatenate([[0], np.cumsum(first)])[at]
    column = (words(short, cuts).hashes >> np.uint64(32)) % np.uint64(DIMENSIONS - 1)
    flat = row * DIMENSIONS + column.astype(np.int64)
    same = np.zeros(len(row), bool)
    same[1:] = (plain.hashes[1:] == plain.hashes[:-1]) & (row[1:] == row[:-1])
    again = row[same] * DIMENSIONS + DIMENSIONS - 1
    return np.bincount(np.concatenate([flat, again]), minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1; texts without words are zero."""
    out = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * idf
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each column, and all documents as column -1."""
    held, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for _, _, data, at in slices(batch.column(0), most_rows=ROWS):
            held += (shape_counts(data, at) > 0).sum(axis=0)
            n += len(at) - 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], held]))], names=["c", "n"]
    )


def _vectors(idf: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column(0), most_rows=ROWS):
                made = _weighted(shape_counts(data, at), idf)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, made.size + 1, DIMENSIONS, dtype=np.int32)), pa.array(made.ravel())
                )
                yield pa.RecordBatch.from_arrays([flat, batch.column(1).slice(first, end - first)], names=["v", "y"])

    return run


def latent_space(vectors: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(columns, rank) right singular vectors of the largest singular values."""
    _, basis = np.linalg.eigh(vectors.T.astype(np.float64) @ vectors)
    return basis[:, ::-1][:, :rank].astype(np.float32)


def votes(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Label means of the nearest rows of ``known``, weighted by cosine similarity."""
    near = vectors @ known.T
    k = min(neighbours, len(labels))
    if k < len(labels):
        places = np.argpartition(-near, k - 1, axis=1)[:, :k]
    else:
        places = np.broadcast_to(np.arange(k), (len(near), k))
    weight = np.maximum(np.take_along_axis(near, places, axis=1), 0).astype(np.float64) ** SHARPNESS
    prior = labels.mean()
    return np.clip((weight * labels[places]).sum(axis=1) + PRIOR_WEIGHT * prior, 0, None) / (weight.sum(axis=1) + PRIOR_WEIGHT)


def score(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    labelled: int = LABELLED,
) -> DataFrame:
    """(key, score, predicted): one row per input row; ``score`` is the vote for label 1, from 0 to 1.

    ``learn`` is a condition on the key: labels of other rows are not used. Equal texts are one labelled text with the
    mean of their labels; null labels and keys teach nothing. A text without words (null, empty, blank) has similarity
    0 to all and scores the mean label. Without any label every score is 0.5. Repeated rows give repeated results; an
    empty table gives no rows. Other columns are ignored, whatever their names; texts are read whole.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = dict(source.dtypes)["key"]
    marked = labels.where(learn & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"))
    # Only hashes of the texts meet the labels; the texts of the chosen are found again where they stand.
    hashed = source.withColumns({"t0": F.xxhash64("text"), "t1": F.xxhash64(F.lit(1), "text")})
    taught = hashed.select("key", "t0", "t1").join(marked, "key")
    means = taught.groupBy("t0", "t1").agg(F.avg("y").alias("y"))
    # The bound of the sample: the smallest hashes of distinct texts.
    chosen = materialise(means.orderBy("t0", "t1").limit(labelled), "labelled")
    texts = hashed.select("t0", "t1", "text").join(F.broadcast(chosen), ["t0", "t1"]).dropDuplicates(["t0", "t1"])

    held = source.select("text").mapInArrow(_frequencies, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(held["c"], held["n"], strict=True))
    idf = np.log((1 + n.get(-1, 0)) / (1 + np.array([n.get(c, 0) for c in range(DIMENSIONS)]))) + 1
    sample = texts.select("text", "y").mapInArrow(_vectors(idf), "v array<float>, y double").toPandas()
    if len(sample):
        vectors = np.stack(sample["v"].to_numpy()).astype(np.float32)
        basis = latent_space(vectors)
        known = vectors @ basis
        known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
        model = spark.sparkContext.broadcast((idf, basis, known, sample["y"].to_numpy(np.float64)))
    else:
        model = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column(1), most_rows=ROWS):
                if model is None:
                    p = np.full(end - first, 0.5)
                else:
                    weights, space, near, y = model.value
                    found = _weighted(shape_counts(data, at), weights) @ space
                    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
                    p = np.clip(votes(found, near, y), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                    names=["key", "score", "predicted"],
                )

    return source.mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
