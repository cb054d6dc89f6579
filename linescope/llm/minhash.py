"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of 2**32 shingle ids make every coordinate: ``sigma`` scatters the ids, and coordinate
``k`` is the smallest ``pi(sigma(id) + k)``, the same ``pi`` shifted circularly by ``k``.

1. Each text becomes its set fingerprint, band keys and a one-bit sketch of the coordinates. Equal sets are one node.
2. Every node is compared with the smallest node of each of its buckets, on the full sets.
3. Buckets that still hold several components draw more pivots, in rounds: large groups of near copies close here with
   a number of comparisons in proportion to their nodes.
4. What lies outside the largest component of a bucket is compared with all of the bucket, again on the full sets: as
   pairs where sizes and sketches allow a link, or in blocks of bounded size where a bucket has many. No link among the
   candidates is lost.
5. Components are contracted in the shared folder.

No pairs of a group are listed, equal texts meet only in a combinable aggregate, and every join key may be hot: the
joins are left to adaptive skew splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.graph import components
from linescope.llm.words import mix, shingles, slices, words
from linescope.session import materialise

BANDS = 32
ROWS = 5
#: Coordinates handled at once, so that they stay in the processor's cache.
BLOCK = 1 << 14
SKETCH_BITS = BANDS * ROWS
#: Lower-bit agreements of a pair at similarity s have mean (1 + s) / 2; five deviations are left below it.
DEVIATIONS = 5.0
#: Pivots that a bucket with several components draws in a round, and rounds.
PIVOTS = 8
ROUNDS = 1
#: Buckets with up to this many comparisons left list them as pairs; larger ones are compared in blocks of nodes.
SMALL = 256
BLOCK_NODES = 512
#: Shared shingles that a block holds at once.
BLOCK_HITS = 1 << 21

_U32 = np.uint32


def sigma(ids: np.ndarray) -> np.ndarray:
    """First permutation of [0, 2**32)."""
    x = (ids ^ (ids >> _U32(16))) * _U32(0x7FEB352D)
    x = (x ^ (x >> _U32(15))) * _U32(0x846CA68B)
    return x ^ (x >> _U32(16))


def pi(x: np.ndarray) -> np.ndarray:
    """Second permutation of [0, 2**32)."""
    x = x * _U32(0x9E3779B1)
    x ^= x >> _U32(15)
    x *= _U32(0x2C1B3C6D)
    x ^= x >> _U32(12)
    x *= _U32(0x297A2D39)
    return x


def signatures(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """(rows, size) coordinates of the sets ``values[at[i]:at[i+1]]``, none of them empty."""
    rows = len(at) - 1
    out = np.empty((rows, size), np.uint32)
    first = 0
    while first < rows:
        end = int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1
        end = min(max(end, first + 1), rows)
        base = sigma((values[at[first] : at[end]] >> np.uint64(32)).astype(np.uint32))
        cuts = at[first:end] - at[first]
        for k in range(size):
            out[first:end, k] = np.minimum.reduceat(pi(base + _U32(k)), cuts)
        first = end
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingles, row offsets) of a text column."""
    for first, end, data, at in slices(column):
        values, cuts = shingles(words(data, at), size)
        sets = [np.unique(values[cuts[i] : cuts[i + 1]]) for i in range(end - first)]
        yield first, end, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bytes for every set."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if len(full):
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[full, i] = mix(np.add.reduceat(mix(values ^ np.uint64(salt)), at[full]))
    return out


def _nodes(prints: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(prints.astype(">u8")).tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def _signed_rows(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, values, at in shingle_sets(batch.column(1), size):
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros((end - first, bands), np.uint64)
                sketch = np.zeros((end - first, 3), np.uint64)
                if len(full):
                    cuts = np.append(at[full], at[-1])
                    marks = signatures(values, cuts, bands * rows)
                    wide = marks.astype(np.uint64).reshape(len(full), bands, rows)
                    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                    key = np.broadcast_to(key, (len(full), bands))
                    for j in range(rows):
                        key = mix(key + wide[:, :, j])
                    keys[full] = key
                    bits = np.zeros((len(full), 192), np.uint8)
                    used = min(192, bands * rows)
                    bits[:, :used] = marks[:, :used] & 1
                    sketch[full] = np.packbits(bits, axis=1).view(np.uint64).reshape(len(full), 3)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)),
                    pa.array(_signed(keys[full].ravel())),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(n.astype(np.int64)),
                        _nodes(_fingerprints(values, at)),
                        batch.column(2).slice(first, end - first),
                        flat,
                        *[pa.array(_signed(np.ascontiguousarray(sketch[:, i]))) for i in range(3)],
                    ],
                    names=["key", "n", "node", "text_key", "bands", "s0", "s1", "s2"],
                )

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, at in shingle_sets(batch.column(0), size):
                flat = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(_signed(values)))
                yield pa.RecordBatch.from_arrays([_nodes(_fingerprints(values, at)), flat], names=["node", "members"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity: 100 * shared >= percent * united."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("m_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("m_b"))
    shared = F.size(F.array_intersect("m_a", "m_b"))
    both = pairs.join(left, "a").join(right, "b")
    sized = both.select("a", "b", shared.alias("i"), (F.size("m_a") + F.size("m_b")).alias("t"))
    return sized.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b")


def _sets(docs: DataFrame, text: str, signed: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, members) of the given nodes, from one text of each."""
    chosen = signed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    texts = docs.select(F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = texts.join(chosen.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"])
    made = found.select("text").mapInArrow(_set_rows(size), "node binary, members array<bigint>")
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row per input row.

    Texts are linked at 100 * shared >= ``percent`` * united of their distinct ``size``-word shingles. The component is
    the smallest key that links reach. A text without words (null, empty, white space) has no shingles, is linked with
    nothing and keeps its own key. Repeated rows give repeated results; equal keys with different texts are different
    documents. A null key is a member like any other, but never names a component that has another key. An empty table
    gives no rows. Other columns are ignored, whatever their names. Every shingle of a text counts, however long it is.

    Candidates come from ``bands`` bands of ``rows`` coordinates: a pair at similarity s is missed with probability
    (1 - s**rows)**bands.
    """
    out = _placed(docs, key, text, size, percent, bands, rows)
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of every component, that with the smallest key (null last).

    Rows without words stay. Other cases are treated as in :func:`near_duplicates`; repeated rows leave one.
    """
    placed = materialise(_placed(docs, key, text, size, percent, BANDS, ROWS).where("component is not null"), "placed")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_key")).alias("x"))
    chosen = first.select(F.col("x.key").alias("k"), F.col("x.text_key").alias("t")).withColumn("one", F.lit(True))
    whole = F.col(f"`{text}`").cast("string")
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{key}`").alias("key"),
        F.xxhash64(whole).alias("text_key"),
        F.coalesce(whole.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)).alias("worded"),
    )
    joined = held.where("worded").join(chosen, (F.col("text_key") == F.col("t")) & F.col("key").eqNullSafe(F.col("k")), "left_semi")
    kept = joined.groupBy("text_key", "key").agg(F.first("row").alias("row")).select("row")
    out = kept.union(held.where("not worded").select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _placed(docs: DataFrame, key: str, text: str, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(key, n, text_key, component, component_id) per row; the component is null for texts without words."""
    if bands * rows > 192:
        raise ValueError("the sketch holds 192 coordinates")
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["key"]
    signed = materialise(
        source.select("key", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
            _signed_rows(size, bands, rows),
            f"key {kind}, n bigint, node binary, text_key bigint, bands array<bigint>, s0 bigint, s1 bigint, s2 bigint",
        ),
        "signed",
    )
    groups = signed.where("n > 0").groupBy("node").agg(F.min("key").alias("low"), F.min("n").alias("n"))
    # Equal sets have equal bands and sketches; one row stands for them.
    heads = signed.where("n > 0").select("node", "n", "bands", "s0", "s1", "s2").dropDuplicates(["node"])
    banded = materialise(
        heads.select("node", "n", "s0", "s1", "s2", F.explode("bands").alias("bucket")), "banded"
    )
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = materialise(banded.join(buckets.select("bucket", "pivot"), "bucket"), "buckets")
    first = materialise(
        shared.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs"
    )
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    sets = materialise(_sets(docs, text, signed, nodes, size), "sets")
    links = materialise(_linked(first, sets, percent), "links")
    once = materialise(components(links), "components")

    # What the first pivots have not joined: more pivots, then all nodes of different components in one bucket.
    for salt in range(ROUNDS):
        rest = materialise(_open(shared, once), "rest")
        links = materialise(_linked(_to_pivots(rest, salt, percent, bands * rows), sets, percent), "links")
        once = materialise(components(_stars(once).union(links)), "components")
    rest = materialise(_open(shared, once).join(heads.select("node", "bands"), "node"), "rest")
    small = F.col("n_all") * F.col("n_minor") <= SMALL
    more = _linked(_cross(rest.where(small), percent, bands * rows), sets, percent)
    blocks = _by_blocks(rest.where(~small), sets, percent)
    final = components(_stars(once).union(materialise(more.union(blocks), "links")))

    named = groups.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    places = named.join(lows, "component").select("node", "component", "component_id")
    out = signed.select("key", "n", "node", "text_key").join(places, "node", "left")
    return out.select("key", "n", "text_key", "component", "component_id")


def _stars(placed: DataFrame) -> DataFrame:
    """Components found so far as edges: contraction goes on from them."""
    return placed.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _open(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """Bucket rows of buckets that hold several components; ``minor``: not of the bucket's largest component."""
    rows = shared.join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    several = counts.groupBy("bucket").agg(
        F.max(F.struct("c", "component")).alias("largest"), F.sum("c").alias("n_all")
    ).where("n_all > largest.c")
    minor = F.col("component") != F.col("largest.component")
    n_minor = F.col("n_all") - F.col("largest.c")
    return rows.join(several, "bucket").withColumns({"minor": minor, "n_minor": n_minor}).drop("largest")


def _possible(a: dict[str, Column], b: dict[str, Column], percent: int, coordinates: int) -> Column:
    """Different components whose sizes and sketches allow the similarity."""
    used = min(192, coordinates)
    p = (1 + percent / 100) / 2
    least = int(used * p - DEVIATIONS * (used * p * (1 - p)) ** 0.5)
    differ = sum((F.bit_count(a[f"s{i}"].bitwiseXOR(b[f"s{i}"])) for i in range(3)), F.lit(0))
    return (
        (a["component"] != b["component"])
        & (F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent)
        & (differ <= used - least)
    )


_FIELDS = ("node", "n", "s0", "s1", "s2", "component")


def _to_pivots(rest: DataFrame, salt: int, percent: int, coordinates: int) -> DataFrame:
    """Distinct pairs of a node and one of the ``PIVOTS`` pivots that each of its buckets draws by hash."""
    drawn = [
        F.min(F.struct(F.xxhash64(F.lit(salt * PIVOTS + i), "node").alias("h"), *_FIELDS)).alias(f"p{i}")
        for i in range(PIVOTS)
    ]
    pivots = rest.groupBy("bucket").agg(*drawn)
    both = rest.where("minor").join(pivots, "bucket")
    own = {c: F.col(c) for c in _FIELDS}
    fits = F.filter(
        F.array_distinct(F.array(*[F.struct(*[F.col(f"p{i}")[c].alias(c) for c in _FIELDS]) for i in range(PIVOTS)])),
        lambda x: _possible(own, {c: x[c] for c in _FIELDS}, percent, coordinates),
    )
    pairs = both.select("node", F.explode(F.transform(fits, lambda x: x["node"])).alias("pivot"))
    return pairs.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()


def _cross(rest: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """The pairs of one bucket and different components that sizes and sketches leave possible, each once."""

    def side(name: str) -> DataFrame:
        return rest.select("bucket", *[F.col(c).alias(f"{c}_{name}") for c in (*_FIELDS, "bands", "minor")])

    # One side is outside the largest component; pairs of two such nodes come in one order.
    a, b = side("a").where("minor_a"), side("b")
    left, right = ({c: d[f"{c}_{n}"] for c in _FIELDS} for d, n in ((a, "a"), (b, "b")))
    fits = (~b["minor_b"] | (left["node"] < right["node"])) & _possible(left, right, percent, coordinates)
    # A pair that shares several buckets counts in the first.
    shared = F.zip_with(a["bands_a"], b["bands_b"], lambda x, y: x == y)
    first = F.get(a["bands_a"], (F.array_position(shared, F.lit(True)) - 1).cast("int")) == a["bucket"]
    joined = a.join(b, (a["bucket"] == b["bucket"]) & fits & first)
    return joined.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of ``right``, counts of shared values as rows of ``right`` by rows of ``left``), in pieces."""
    held = np.concatenate(left)
    owner = np.repeat(np.arange(len(left)), [len(x) for x in left])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    first = 0
    while first < len(right):
        size, end, parts = 0, first, []
        while end < len(right) and (size < BLOCK_HITS or end == first):
            lo, hi = np.searchsorted(held, right[end], "left"), np.searchsorted(held, right[end], "right")
            n = hi - lo
            total = int(n.sum())
            at = np.arange(total) + np.repeat(lo - np.cumsum(n) + n, n)
            parts.append(owner[at] + (end - first) * len(left))
            size, end = size + total, end + 1
        counts = np.bincount(np.concatenate(parts), minlength=(end - first) * len(left))
        yield first, counts.reshape(end - first, len(left))
        first = end


def _block_links(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        outside, every = block[block["left"]], block[~block["left"]]
        a, b, seen = [], [], set()
        if len(outside) and len(every):
            nodes, others = outside["node"].to_numpy(), every["node"].to_numpy()
            parts, other_parts = outside["component"].to_numpy(), every["component"].to_numpy()
            sizes = np.array([len(x) for x in outside["members"]])
            other_sizes = np.array([len(x) for x in every["members"]])
            for first, shared in _shared_counts(list(outside["members"]), list(every["members"])):
                total = other_sizes[first : first + len(shared), None] + sizes[None, :]
                for j, i in zip(*np.nonzero(shared * 100 >= (total - shared) * percent), strict=True):
                    # One link for a node and a component is enough.
                    mark = (bytes(nodes[i]), bytes(other_parts[first + j]))
                    if parts[i] != other_parts[first + j] and mark not in seen:
                        seen.add(mark)
                        a.append(bytes(nodes[i]))
                        b.append(bytes(others[first + j]))
        return pd.DataFrame({"a": a, "b": b})

    return run


def _by_blocks(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes outside a bucket's largest component and all of the bucket.

    Both sides are dealt into blocks of about ``BLOCK_NODES`` nodes, and a task compares one pair of blocks at a time.
    """
    held = rest.select("bucket", "node", "component", "minor", "n_all", "n_minor").join(sets, "node")
    held = held.withColumns(
        {
            "of_all": F.ceil(F.col("n_all") / BLOCK_NODES).cast("int"),
            "of_minor": F.ceil(F.col("n_minor") / BLOCK_NODES).cast("int"),
            "h": F.xxhash64("bucket", "node"),
        }
    )
    keep = ["bucket", "node", "component", "members"]
    outside = held.where("minor").select(
        *keep, F.lit(True).alias("left"), F.pmod("h", "of_minor").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("j")
    )
    every = held.select(
        *keep, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("of_minor") - 1)).alias("i"), F.pmod("h", "of_all").cast("int").alias("j")
    )
    return outside.union(every).groupBy("bucket", "i", "j").applyInPandas(_block_links(percent), "a binary, b binary")
