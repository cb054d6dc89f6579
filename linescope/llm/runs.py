"""Periodic runs of words by uniting suffix classes in descending order of their common prefixes.

Suffixes of a text that share their first words form classes. Taken by falling length of the common prefix, classes are
united as Kruskal's algorithm unites trees: neighbours in suffix order with the longest common prefix first. A class
keeps its start positions in order. When two classes meet at a common prefix of L words, positions that become
neighbours in the united set and lie at most L apart overlap themselves: the text repeats at that distance, exactly
L + distance words long if the word before the first position differs from the one before the second.

Every run of period q is found once, at its first word: the suffixes at its start and q words on share length - q words,
and a position between them in the same class would give the run a shorter period. So a seed has the smallest period,
and runs with several periods under others do not come up twice.

Suffixes are sorted by doubling, all texts of a slice at once, and only where four words occur again in their text; the
rest has no common prefix that a run needs. A row is one text, so nothing is shuffled, and memory follows the longest
text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from linescope.llm.tokens import WORD, numbered, spans, strings
from linescope.llm.words import slices

#: Words of a run at least, and how often its period fits.
LEAST, POWER = 6, 4
CHUNK = 1024


class Places:
    """Ascending positions in chunks, so that an insertion moves few of them."""

    __slots__ = ("chunks", "heads", "size")

    def __init__(self, first: int) -> None:
        self.chunks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def around(self, x: int) -> tuple[int, int]:
        """Neighbours of an absent position; -1 where there is none."""
        k = max(bisect_left(self.heads, x) - 1, 0)
        chunk = self.chunks[k]
        at = bisect_left(chunk, x)
        before = chunk[at - 1] if at else -1
        if at < len(chunk):
            return before, chunk[at]
        return before, self.heads[k + 1] if k + 1 < len(self.heads) else -1

    def add(self, x: int) -> None:
        k = max(bisect_left(self.heads, x) - 1, 0)
        chunk = self.chunks[k]
        insort(chunk, x)
        self.size += 1
        self.heads[k] = chunk[0]
        if len(chunk) > 2 * CHUNK:
            self.chunks.insert(k + 1, chunk[CHUNK:])
            self.heads.insert(k + 1, chunk[CHUNK])
            del chunk[CHUNK:]


def suffix_order(ids: np.ndarray, first: np.ndarray, shared: int) -> list[np.ndarray]:
    """Groups of one array each: start positions of suffixes that share ``shared`` words (a power of two) with others of
    their row, in suffix order, groups one after the other with their sizes.

    Returns ``[positions, group]``; ``group`` numbers the groups.
    """
    n = len(ids)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    rank = np.zeros(n, np.int64)
    held = np.arange(n)
    key = rows * (int(ids.max(initial=0)) + 1) + ids
    size, group = 1, None
    while True:
        order = np.argsort(key, kind="stable")
        held, key = held[order], key[order]
        fresh = np.ones(len(held), bool)
        fresh[1:] = key[1:] != key[:-1]
        # A slot is a place in the order of all suffixes; a group keeps the slots it had, rank is its first slot.
        if size == 1:
            slot = np.arange(n)
        else:
            slot = base[np.searchsorted(base_at, np.arange(len(held)), "right") - 1] + np.arange(len(held))
            slot -= base_at[np.searchsorted(base_at, np.arange(len(held)), "right") - 1]
        head = np.flatnonzero(fresh)
        counts = np.diff(np.append(head, len(held)))
        rank[held] = np.repeat(slot[head], counts)
        tied = np.repeat(counts > 1, counts)
        if size == shared:
            # From here on only these positions matter; their groups are final.
            kept, group = held[tied], np.full(n, -1)
            group[kept] = rank[kept]
            slots = np.full(n, -1)
        if size >= shared:
            slots[held] = slot
        held = held[tied]
        if not len(held):
            break
        # Suffixes in the same group are next to each other, in the order of their groups.
        base, base_at = np.unique(rank[held], return_index=True)
        after = held + size
        second = np.where(after < end[held], rank[np.minimum(after, n - 1)], -1)
        key = rank[held] * (n + 1) + second + 1
        size *= 2
    if group is None:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    kept = kept[np.argsort(slots[kept], kind="stable")]
    return [kept, group[kept]]


def common_prefixes(words: list[int], ends: list[int], places: np.ndarray, group: np.ndarray, shared: int) -> np.ndarray:
    """Common prefix of every place and the next one in suffix order, 0 where the next is of another group.

    In text order a prefix is at most one word shorter than the one before.
    """
    same = np.append(group[1:] == group[:-1], False)
    follower = dict(zip(places[same].tolist(), places[np.flatnonzero(same) + 1].tolist(), strict=True))
    out: dict[int, int] = {}
    last, length = -2, 0
    for i in sorted(follower):
        j = follower[i]
        length = max(length - 1, shared) if i == last + 1 else shared
        room = ends[i] - max(i, j)
        while length < room and words[i + length] == words[j + length]:
            length += 1
        out[i], last = length, i
    return np.array([out.get(i, 0) for i in places.tolist()], np.int64)


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """(row, start, length, period) of all runs, in that order; start counts from the row's first word."""
    shared = 1
    # A run of period q shares at least max(least - q, (power - 1) * q) words with itself q words on.
    needed = min(max(least - q, (power - 1) * q) for q in range(1, least + 1))
    while shared * 2 <= needed:
        shared *= 2
    places, group = suffix_order(ids, first, shared)
    if not len(places):
        return np.zeros((0, 4), np.int64)
    words = ids.tolist()
    left = np.empty(len(ids), np.int64)
    left[1:] = ids[:-1]
    left[first[:-1][np.diff(first) > 0]] = -1  # no word
    before = left.tolist()
    ends = np.repeat(first[1:], np.diff(first)).tolist()
    prefix = common_prefixes(words, ends, places, group, shared)
    found: list[tuple[int, int, int]] = []
    parent: dict[int, int] = {}
    sets: dict[int, Places] = {}

    def top(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def seed(i: int, j: int, length: int) -> None:
        q = j - i
        if (power - 1) * q <= length and length + q >= least and before[i] != before[j]:
            found.append((i, length + q, q))

    usable = np.flatnonzero(prefix >= needed)
    for t in usable[np.argsort(-prefix[usable], kind="stable")].tolist():
        length = int(prefix[t])
        a, b = top(int(places[t])), top(int(places[t + 1]))
        big = sets.pop(a, None) or Places(a)
        small = sets.pop(b, None) or Places(b)
        if big.size < small.size:
            a, b, big, small = b, a, small, big
        joining = list(small)
        near = [big.around(x) for x in joining]
        for k, x in enumerate(joining):
            lower, upper = near[k]
            if lower >= 0 and (k == 0 or joining[k - 1] < lower):
                seed(lower, x, length)
            if upper >= 0 and (k + 1 == len(joining) or joining[k + 1] > upper):
                seed(x, upper, length)
            big.add(x)
        parent[b] = a
        sets[a] = big
    if not found:
        return np.zeros((0, 4), np.int64)
    made = np.array(found, np.int64)
    row = np.searchsorted(first, made[:, 0], "right") - 1
    out = np.column_stack([row, made[:, 0] - first[row], made[:, 1], made[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _rows(least: int, power: int, at: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for begin, end, data, offsets in slices(column):
                inside = WORD[data]
                starts, ends, first = spans(inside, offsets)
                ids, _ = numbered(strings(data, inside, starts, ends))
                runs = find_runs(ids, first, least, power)
                cuts = np.searchsorted(runs[:, 0], np.arange(end - begin + 1))
                texts, raw = [], data.tobytes()
                for i in range(end - begin):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    mine = runs[cuts[i] : cuts[i + 1]]
                    if len(mine):
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, mine[:, 1] + mine[:, 3], 1)
                        np.add.at(edge, mine[:, 1] + mine[:, 2], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    texts.append(b" ".join(words))
                lists = pa.ListArray.from_arrays(
                    pa.array(cuts, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(kind.value_type)),
                )
                part = batch.slice(begin, end - begin)
                joined = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, lists.cast(kind), joined], [*batch.schema.names, "_runs", "_collapsed"])

    return run


def periodic_runs(
    docs: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER, runs: str = "runs", collapsed: str = "collapsed"
) -> DataFrame:
    """``docs`` with two more columns: the runs of ``text`` and the text without their repeats.

    A run is a longest stretch of consecutive words with smallest period q (words q apart are equal) of at least
    ``least`` words and ``power`` periods. ``runs`` is an array of (start, length, period) by start, then period, with
    words counted from 0; ``collapsed`` joins by one space all words that no run holds behind its first q words.

    A null, empty or blank text has no words: no runs and an empty text. Every row is judged alone, so repeated rows and
    null keys change nothing, and an empty table gives an empty table. A column of ``docs`` that has the name of an
    added one is replaced; other columns may have any name.
    """
    kept = [c for c in docs.columns if c not in (runs, collapsed) or c == text]
    names = [f"c{i}" for i in range(len(kept))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    one = StructType([StructField(f, LongType(), False) for f in ("start", "length", "period")])
    schema = StructType([*held.schema.fields, StructField("_runs", ArrayType(one, False)), StructField("_collapsed", StringType())])
    out = held.mapInArrow(_rows(least, power, kept.index(text)), schema)
    back = [F.col(n).alias(c) for c, n in zip(kept, names, strict=True) if c not in (runs, collapsed)]
    return out.select(*back, F.col("_runs").alias(runs), F.col("_collapsed").alias(collapsed))
