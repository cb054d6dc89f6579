"""Language-model scoring: word counts as the base and context-tree weighting over bytes as the model.

A text is the byte stream of its lower-cased words, one space between them and one end mark. Each byte is eight binary
decisions; the decision's context at depth d is the d bytes before it. Every node (context, decided bits) holds the
zeros and ones that training put there, a Krichevsky-Trofimov estimate, and the weight that context-tree weighting
gives to stopping there: P(s) = KT(s) / 2 + product of P(children) / 2. A prediction mixes all depths that training
has seen; at a deeper context without training data the mix ends.

The counts of (depth + 1)-byte grams over the whole corpus hold all that the tree needs. Subtrees below three bytes of
context are independent and bounded by 2**24 grams, so partitions by those bytes build them; the nodes above number at
most 2**24 and meet in aggregates. What results is one log probability per gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.words import Words, slices, words
from linescope.session import materialise

DEPTH = 5
#: Bytes of context whose subtrees one partition builds.
SHALLOW = 3
#: Grams that one partition of the tree holds on average.
PART_GRAMS = 400_000
#: Entries of a table (16 bytes each) that are sent to every worker at a time; larger ones take several passes over the texts.
BROADCAST_ENTRIES = 8_000_000
#: Entries that pass through the driver at a time.
CHUNK = 1_000_000
#: Distinct keys that a task gathers before it hands them on.
GATHER = 1_000_000
SLICE = 1 << 21
END = 0xFF  # no byte of UTF-8

WORD, GRAM = 0, 1
#: The end token's key among the word hashes.
END_WORD = np.uint64(0x452821E638D01377)


def stream(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets): words, spaces between, end marks."""
    count = np.diff(found.first)
    rows = len(count)
    length = found.ends - found.starts
    row = np.repeat(np.arange(rows), count)
    size = np.bincount(row, length + 1, minlength=rows).astype(np.int64)
    size[count == 0] = 1
    at = np.concatenate([[0], np.cumsum(size)])
    blank = np.concatenate([[0], np.cumsum(count == 0)])
    place = np.concatenate([[0], np.cumsum(length + 1)])[:-1] + blank[row]
    out = np.full(at[-1], 0x20, np.uint8)
    total = int(length.sum())
    offset = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(place, length) + offset] = found.data[np.repeat(found.starts, length) + offset]
    out[at[1:] - 1] = END
    return out, at


def grams(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Byte and its ``depth`` predecessors as one number, the byte lowest; end marks stand before a text."""
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    out = data.astype(np.int64)
    for d in range(1, depth + 1):
        before = np.full(len(data), END, np.int64)
        before[d:] = data[:-d] if d < len(data) else before[d:]
        before[place < d] = END
        out |= before << (8 * d)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, place = np.unique(keys, return_inverse=True)
    return (found, *[np.bincount(place, v, minlength=len(found)) for v in values])


class _Gather:
    """Counts per key, merged whenever enough has come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, held: bool) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n * (not held)))
        self.size += len(found)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = _summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
        n = n.astype(np.int64)
        self.parts, self.size = [(keys, n)], len(keys)
        return keys, n

    def full(self) -> bool:
        return self.size >= GATHER and len(self.merged()[0]) >= GATHER // 2

    def empty(self) -> None:
        self.parts, self.size = [], 0


def _rows(kind: int, gather: _Gather) -> Iterator[pa.RecordBatch]:
    if gather.parts:
        keys, n = gather.merged()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n)], names=["kind", "k", "n"]
        )
        gather.empty()


def _counted(depth: int) -> Callable:
    """Batches of (held_out, text) to (kind, k, n): training occurrences of every word and gram met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {WORD: _Gather(), GRAM: _Gather()}
        for batch in batches:
            held = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
            for first, end, data, at in slices(batch.column(1), SLICE):
                found = words(data, at)
                out, cuts = stream(found)
                codes = grams(out, cuts, depth)
                for away in (False, True):
                    rows = held[first:end] == away
                    if not rows.any():
                        continue
                    kinds[GRAM].add(codes[np.repeat(rows, np.diff(cuts))], away)
                    if not away:
                        ends = np.full(int(rows.sum()), END_WORD)
                        kinds[WORD].add(_signed(np.concatenate([found.hashes[np.repeat(rows, np.diff(found.first))], ends])), False)
                for kind, gather in kinds.items():
                    if gather.full():
                        yield from _rows(kind, gather)
        for kind, gather in kinds.items():
            yield from _rows(kind, gather)

    return run


# The tree --------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the KT block probability of ``n0`` zeros and ``n1`` ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _log_kt_column(n0: Column, n1: Column) -> Column:
    def log_gamma(x: Column) -> Column:
        shift = reduce(lambda a, b: a + b, [F.log(x + i) for i in range(8)])
        y = x + 8
        series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
        return (y - 0.5) * F.log(y) - y + float(0.5 * np.log(2 * np.pi)) + series - shift

    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - float(np.log(np.pi))


def _decisions(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node key, bit) of the eight decisions of every gram: bits decided so far lowest, then the context."""
    byte, context = codes & 0xFF, codes >> 8
    for b in range(8):
        yield ((1 << b) | (byte >> (8 - b))) | (context << 8), (byte >> (7 - b)) & 1


def _mask(depth: int) -> int:
    return (1 << (8 * (depth + 1))) - 1


@dataclass
class Level:
    """Nodes of one depth, sorted by key: probability of a one, and weight of stopping here."""

    keys: np.ndarray
    one: np.ndarray
    stop: np.ndarray


def deep_levels(codes: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[dict[int, Level], tuple[np.ndarray, ...]]:
    """Levels ``depth`` to ``top`` of the tree of these grams, and (keys, n0, n1, log P) of level ``top``."""
    seen = n > 0
    codes, n = codes[seen], n[seen].astype(float)
    keys, zeros, ones = [], [], []
    for key, bit in _decisions(codes):
        keys.append(key)
        ones.append(n * bit)
        zeros.append(n * (1 - bit))
    key, n0, n1 = _summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
    log_p = log_kt(n0, n1)
    levels = {depth: Level(key, (n1 + 0.5) / (n0 + n1 + 1), np.ones(len(key)))}
    for d in range(depth - 1, top - 1, -1):
        key, n0, n1, below = _summed(key & _mask(d), n0, n1, log_p)
        kt = log_kt(n0, n1)
        log_p = np.logaddexp(kt, below) + np.log(0.5)
        levels[d] = Level(key, (n1 + 0.5) / (n0 + n1 + 1), 1 / (1 + np.exp(np.clip(below - kt, -700, 700))))
    return levels, (key, n0, n1, log_p)


def log_probabilities(codes: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 probability of every gram's byte in its context."""
    total = np.zeros(len(codes))
    for key, bit in _decisions(codes):
        p = np.full(len(codes), 0.5)
        begun = np.zeros(len(codes), bool)
        for d in sorted(levels, reverse=True):
            level = levels[d]
            if not len(level.keys):
                continue
            wanted = key & _mask(d)
            place = np.minimum(np.searchsorted(level.keys, wanted), len(level.keys) - 1)
            here = level.keys[place] == wanted
            one, stop = level.one[place], level.stop[place]
            p = np.where(here, np.where(begun, stop * one + (1 - stop) * p, one), p)
            begun |= here
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


def _whole(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(f["k"].to_numpy(), f["n"].to_numpy()) for f in frames]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(k, v): log10 probability of the byte of every counted gram, in its context."""
    spark = counts.sparkSession
    parts = max(1, -(-counts.count() // PART_GRAMS))
    # The three bytes before the coded one name the subtree.
    dealt = counts.repartition(parts, F.expr("shiftright(k, 8) & 16777215"))

    def top_nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, n = _whole(frames)
        if (n > 0).any():
            _, (key, n0, n1, log_p) = deep_levels(codes, n, depth, SHALLOW)
            yield pd.DataFrame({"k": key, "n0": n0, "n1": n1, "p": log_p})

    level = materialise(dealt.mapInPandas(top_nodes, "k bigint, n0 double, n1 double, p double"), "tree")
    shallow: dict[int, Level] = {}
    for d in range(SHALLOW - 1, -1, -1):
        summed = level.groupBy(F.col("k").bitwiseAND(F.lit(_mask(d))).alias("k")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("p").alias("below")
        )
        kt = _log_kt_column(F.col("n0"), F.col("n1"))
        mixed = F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("below")))) + float(np.log(0.5))
        level = materialise(summed.withColumn("kt", kt).withColumn("p", mixed), "tree")
        # At most 256**2 * 255 nodes, by the keys' width.
        held = level.orderBy("k").select("k", "n0", "n1", "kt", "below").toPandas()
        n0, n1, below, own = (held[c].to_numpy() for c in ("n0", "n1", "below", "kt"))
        shallow[d] = Level(held["k"].to_numpy(), (n1 + 0.5) / (n0 + n1 + 1), 1 / (1 + np.exp(np.clip(below - own, -700, 700))))
    above = spark.sparkContext.broadcast({d: (x.keys, x.one, x.stop) for d, x in shallow.items()})

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, n = _whole(frames)
        if len(codes):
            deep = deep_levels(codes, n, depth, SHALLOW)[0] if (n > 0).any() else {}
            levels = {**{d: Level(*x) for d, x in above.value.items()}, **deep}
            yield pd.DataFrame({"k": codes, "v": log_probabilities(codes, levels)})

    return dealt.mapInPandas(scored, "k bigint, v double")


# Scoring ---------------------------------------------------------------------------------


def _packs(table: DataFrame, value: str, entries: int, most: int) -> Iterator[tuple]:
    """Packs (low, high, cuts, broadcasts) of about ``most`` entries: a range of keys on every worker as sorted arrays.

    A pack is made of ranges of about ``CHUNK`` entries, so the driver sees no more than that at a time. The packs cover
    all keys; None is an open end.
    """
    spark = table.sparkSession
    parts = max(1, -(-entries // CHUNK))
    cuts = sorted({int(c) for c in table.approxQuantile("k", [i / parts for i in range(1, parts)], 0.002)}) if parts > 1 else []
    ranges = list(zip([None, *cuts], [*cuts, None], strict=True))
    k = F.col("k")
    size = max(1, most // CHUNK) if entries > most else len(ranges)
    for first in range(0, len(ranges), size):
        sent = []
        for low, high in ranges[first : first + size]:
            held = table.where((k >= low if low is not None else F.lit(True)) & (k < high if high is not None else F.lit(True)))
            rows = held.orderBy("k").select("k", value).toArrow()
            sent.append(spark.sparkContext.broadcast((rows["k"].to_numpy(), rows[value].to_numpy())))
            del rows
        some = ranges[first : first + size]
        yield some[0][0], some[-1][1], np.array([low for low, _ in some[1:]], np.int64), sent


def _within(keys: np.ndarray, pack) -> np.ndarray | slice:
    """Places of the keys that a pack covers; all for a single pack, none without one."""
    if pack is None:
        return slice(0)
    low, high = pack[:2]
    if low is None and high is None:
        return slice(None)
    return (keys >= (low if low is not None else np.iinfo(np.int64).min)) & (True if high is None else keys < high)


def _looked_up(keys: np.ndarray, pack) -> np.ndarray:
    """Values of sorted keys, 0 for unknown ones."""
    _, _, cuts, sent = pack
    edges = [0, *np.searchsorted(keys, cuts), len(keys)]
    out = np.zeros(len(keys))
    for part, low, high in zip(sent, edges[:-1], edges[1:], strict=True):
        known, values = part.value
        if low < high and len(known):
            wanted = keys[low:high]
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            out[low:high] = np.where(known[place] == wanted, values[place], 0.0)
    return out


def _values(keys: np.ndarray, pack) -> np.ndarray:
    """Values of keys in any order, 0 for unknown ones."""
    if pack is None:
        return np.zeros(len(keys))
    met, place = np.unique(keys, return_inverse=True)
    return _looked_up(met, pack)[place]


def _pieces(batch: pa.RecordBatch, depth: int):
    """(first row, end row, word keys, words' rows, grams, grams' rows) of each slice."""
    for first, end, data, at in slices(batch.column(batch.num_columns - 1)):
        found = words(data, at)
        out, cuts = stream(found)
        count = np.diff(found.first)
        rows = np.arange(end - first)
        keys = np.concatenate([_signed(found.hashes), _signed(np.full(end - first, END_WORD))])
        places = np.concatenate([np.repeat(rows, count), rows])
        yield first, end, keys, places, grams(out, cuts, depth), np.repeat(rows, np.diff(cuts))


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, depth: int = DEPTH,
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes): one row per input row.

    ``held_out`` marks the rows that nothing is learned from. ``score`` is the log10 probability of the text under
    the context tree, ``-score / n_bytes / log10(2)`` its code length in bits per byte, ``base_score`` the sum of
    log10((c + 1) / (N + V + 1)) over words and end. A null, empty or blank text is its end mark alone. Repeated rows
    are learned and scored as often as they occur. Without training rows every decision has probability 1/2. An empty
    table gives no rows. Other columns are ignored, whatever their names; texts count whole.
    """
    away = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    source = docs.select(F.col(key).alias("key"), away.alias("held"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = dict(source.dtypes)["key"]
    counts = materialise(
        source.select("held", "text")
        .mapInArrow(_counted(depth), "kind tinyint, k bigint, n bigint")
        .groupBy("kind", "k")
        .agg(F.sum("n").alias("n")),
        "counts",
    )
    tokens = counts.where(F.col("kind") == WORD).select("k", "n")
    n_all, n_distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scores = materialise(gram_scores(counts.where(F.col("kind") == GRAM).select("k", "n"), depth), "gram-scores")
    space = np.log10(n_all + n_distinct + 1)
    n_grams = scores.count()
    if max(n_distinct, n_grams) <= broadcast_entries:
        packs = [next(_packs(t, v, n, broadcast_entries)) for t, v, n in ((tokens, "n", n_distinct), (scores, "v", n_grams))]
        made = _passed(source, kind, *packs, depth, space)
    else:
        # Rows keep their number from pass to pass; only numbers and sums move, never the words of a text.
        numbered = materialise(source.withColumn("row", F.monotonically_increasing_id()), "rows")
        texts, parts = numbered.select("row", "held", "text"), []
        for pair in zip_longest(_packs(tokens, "n", n_distinct, broadcast_entries), _packs(scores, "v", n_grams, broadcast_entries)):
            parts.append(materialise(_passed(texts, "bigint", *pair, depth, space).drop("held").withColumnRenamed("key", "row"), "pass"))
            for _, _, _, sent in filter(None, pair):
                for part in sent:
                    part.unpersist()
        sums = reduce(DataFrame.union, parts).groupBy("row").agg(*[F.sum(c).alias(c) for c in parts[0].columns[1:]])
        made = numbered.select("row", "key", "held").join(sums, "row").drop("row")
    return made.select(
        F.col("key").alias(key),
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
    )


def _passed(source: DataFrame, kind: str, known, logs, depth: int, space: float) -> DataFrame:
    """Figures of every text (key, held, text) over its words and grams that these packs of the tables cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, keys, places, codes, spots in _pieces(batch, depth):
                rows = end - first
                here = _within(keys, known)
                keys, places = keys[here], places[here]
                c = _values(keys, known)
                here = _within(codes, logs)
                codes, spots = codes[here], spots[here]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(first, rows) for i in (0, 1)],
                        pa.array(np.bincount(places, minlength=rows).astype(np.int64)),
                        pa.array(np.bincount(places, c > 0, minlength=rows).astype(np.int64)),
                        pa.array(np.bincount(places, np.log10(c + 1) - space, minlength=rows).astype(float)),
                        pa.array(np.bincount(spots, _values(codes, logs), minlength=rows).astype(float)),
                        pa.array(np.bincount(spots, minlength=rows).astype(np.int64)),
                    ],
                    names=["key", "held", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
                )

    return source.mapInArrow(
        run, f"key {kind}, held boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint"
    )
