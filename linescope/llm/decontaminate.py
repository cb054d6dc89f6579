"""Benchmark decontamination by SimHash of item-sized windows, a Hamming multi-index and exact verification.

All of it is DataFrame expressions. Shingles are five words; a window is as long as a benchmark item.

1. A window without any shingle of a benchmark has similarity 0 to all items. Windows are therefore laid only where a
   document shares a shingle with an item of that length, so that the shared shingles stand at one place. Nothing else
   is left out.
2. Every window and item gets a 64-bit SimHash of its weighted shingles (weight: occurrences).
3. The fingerprint is cut into eight blocks of eight bits. If two fingerprints differ in at most ``RADIUS`` = 23 bits,
   some block differs in at most two. Items enter the index under every block value within two bits, windows look up
   their own blocks: no pair within the radius is lost. Pairs beyond it are dropped.
4. What is left is compared exactly: sum of minima over sum of maxima of the shingle weights.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.rows import exploded, inlined
from linescope.functions.text import bind
from linescope.session import materialise

SIZE = 5
PERCENT = 80
RADIUS = 23
BLOCKS = 8
#: Flips of at most two of eight bits.
FLIPS = [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(8), k)]
#: Benchmark shingles (16 bytes each) up to this many are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def _hashes(text: Column) -> Column:
    """Hash of every word, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: Column, size: int) -> Column:
    """Hash of the ``size`` words at every place; empty for fewer words."""
    places = F.when(F.size(hashes) >= size, F.sequence(F.lit(0), F.size(hashes) - size)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))


def fingerprint(shingles: Column) -> Column:
    """64-bit SimHash: bit b is set where more than half of the shingles, repeats included, have it.

    Each sum holds the counts of two bits, 32 bits apart, so that one pass over the shingles serves both.
    """
    lanes = (1 << 32) | 1

    def vote(j: int, s: Column) -> Column:
        counts = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(lanes)))
        low = F.when(counts.bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.size(s), F.lit(1 << j)).otherwise(F.lit(0))
        high_bit = (1 << (j + 32)) - (1 << 64 if j == 31 else 0)
        high = F.when(F.shiftrightunsigned(counts, 32) * 2 > F.size(s), F.lit(high_bit)).otherwise(F.lit(0))
        return low.cast("bigint").bitwiseOR(high.cast("bigint"))

    def voted(s: Column) -> Column:
        out = vote(0, s)
        for j in range(1, 32):
            out = out.bitwiseOR(vote(j, s))
        return out

    return bind(voted, shingles)


def _blocks(print_: Column) -> list[Column]:
    return [F.shiftrightunsigned(print_, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(BLOCKS)]


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words, size, shingles, print): benchmark items that have a word, each with its shingle size."""
    rows = benchmark.select(F.col(item).alias("item"), _hashes(F.col(text).cast("string")).alias("h")).withColumn(
        "words", F.size("h")
    )
    rows = rows.where("words > 0").withColumn("size", F.least("words", F.lit(SIZE)))
    made = F.coalesce(*[F.when(F.col("size") == k, _shingles(F.col("h"), k)) for k in range(1, SIZE + 1)])
    rows = rows.withColumn("shingles", made)
    return materialise(rows.select("item", "words", "size", "shingles", fingerprint(F.col("shingles")).alias("print")), "items")


def _laid(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """(t0, t1, windows): every text that shares a shingle with an item, and the (start, words, size) of its windows."""
    # (shingle, size, words, at): several items of one length share a row.
    grams = materialise(
        items.select("size", "words", F.posexplode("shingles").alias("at", "shingle")).distinct(), "benchmark-shingles"
    )
    n = grams.count()
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most SIZE values
    whole = F.col(text).cast("string")
    found = None
    for k in sizes:
        rows = exploded(
            docs,
            [F.xxhash64(whole).alias("t0"), F.xxhash64(F.lit(1), whole).alias("t1")],
            bind(lambda h, k=k: _shingles(h, k), _hashes(whole)),
            "shingle",
            "place",
        )
        side = grams.where(F.col("size") == k)
        hit = rows.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, "shingle")
        made = hit.select("t0", "t1", (F.col("place") - F.col("at")).alias("start"), "words", "size")
        found = made if found is None else found.union(made)
    if found is None:
        return None
    return found.distinct().groupBy("t0", "t1").agg(F.collect_list(F.struct("start", "words", "size")).alias("windows"))


def similarity(left: Column, right: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists: sum of minima over sum of maxima of the occurrences.

    Repeats are numbered, so the two lists become sets of equal total weight.
    """

    def numbered(s: Column) -> Column:
        return bind(
            lambda o: F.transform(
                o, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(o, x)).cast("int").alias("k"))
            ),
            F.array_sort(s),
        )

    def ratio(a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        return shared / (F.size(a) + F.size(b) - shared)

    return bind(ratio, numbered(left), numbered(right))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    percent: int = PERCENT,
) -> DataFrame:
    """(key, item, similarity, start, n_words): the best window of each document and item at ``percent`` or more.

    ``start`` counts words from 0. Words are lower-cased and cut at ASCII white space. An item with fewer than five words
    is one shingle; null, empty and blank items and texts have no windows and match nothing. Equal keys and repeated
    rows give one row per item, a null key is a key. Of windows with equal similarity the first counts. An empty table
    on either side gives no rows. Other columns are ignored, whatever their names; texts are searched whole.
    """
    found = _text_leaks(docs, benchmark, text, item, item_text, percent)
    whole = F.col(text).cast("string")
    rows = docs.select(
        F.col(key).alias("key"), F.xxhash64(whole).alias("t0"), F.xxhash64(F.lit(1), whole).alias("t1")
    ).join(found, ["t0", "t1"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "words")).alias("best")
    return rows.groupBy("key", "item").agg(best).select(
        F.col("key").alias(key),
        F.col("item").alias(item),
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.start")).cast("bigint").alias("start"),
        F.col("best.words").cast("bigint").alias("n_words"),
    )


def _text_leaks(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, percent: int) -> DataFrame:
    """(t0, t1, item, similarity, start, words) per distinct text that has a window at the similarity."""
    whole = F.col(text).cast("string")
    items = _items(benchmark, item, item_text)
    laid = _laid(docs.where(whole.isNotNull()), items, text)
    if laid is None:  # no item has a word
        laid = docs.select(
            F.xxhash64(whole).alias("t0"), F.xxhash64(F.lit(1), whole).alias("t1"),
            F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("words"), F.lit(0).alias("size"))).alias("windows"),
        ).where(F.lit(False))
    laid = materialise(laid, "windows")
    texts = docs.select(
        whole.alias("text"), F.xxhash64(whole).alias("t0"), F.xxhash64(F.lit(1), whole).alias("t1")
    ).join(laid.select("t0", "t1"), ["t0", "t1"], "left_semi").dropDuplicates(["t0", "t1"])

    def cut(hashes: Column, windows: Column) -> Column:
        # A window that a text's ends cut off is moved inside; a text shorter than the item is one window.
        moved = F.transform(
            windows,
            lambda w: F.struct(
                F.greatest(F.least(w["start"], F.size(hashes) - w["words"]), F.lit(0)).alias("start"),
                w["words"].alias("words"),
                w["size"].alias("size"),
            ),
        )
        return F.transform(
            F.array_distinct(moved),
            lambda w: F.struct(
                w["start"].alias("start"),
                w["words"].alias("words"),
                F.coalesce(
                    *[
                        F.when(w["size"] == k, bind(lambda h, k=k: _shingles(h, k), F.slice(hashes, w["start"] + 1, w["words"])))
                        for k in range(1, SIZE + 1)
                    ]
                ).alias("shingles"),
            ),
        )

    windows = inlined(texts.join(laid, ["t0", "t1"]), ["t0", "t1"], bind(cut, _hashes(F.col("text")), F.col("windows")), "start")
    printed = materialise(windows.withColumn("print", fingerprint(F.col("shingles"))), "prints")
    index = items.select(
        "item",
        "words",
        F.col("print").alias("item_print"),
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("block"), b.bitwiseXOR(F.lit(f)).alias("value")) for i, b in enumerate(_blocks(F.col("print"))) for f in FLIPS])
        ).alias("at"),
    ).select("item", "words", "item_print", "at.block", "at.value")
    probes = printed.select(
        "t0", "t1", "start", "words", "print",
        F.explode(F.array(*[F.struct(F.lit(i).alias("block"), b.alias("value")) for i, b in enumerate(_blocks(F.col("print")))])).alias("at"),
    ).select("t0", "t1", "start", "words", "print", "at.block", "at.value")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    candidates = probes.join(index, ["block", "value", "words"]).where(near).select("t0", "t1", "start", "words", "item").distinct()
    pairs = candidates.join(printed.select("t0", "t1", "start", "words", "shingles"), ["t0", "t1", "start", "words"]).join(
        items.select("item", F.col("shingles").alias("item_shingles")), "item"
    )
    verified = pairs.select("t0", "t1", "item", "start", "words", similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity"))
    return verified.where(F.col("similarity") * 100 >= percent)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` whose text has no window at the similarity, with their own columns only.

    Null and empty texts stay. Cases are treated as in :func:`leaks`.
    """
    bad = materialise(_text_leaks(docs, benchmark, text, item, item_text, percent).select("t0", "t1").distinct(), "leaks")
    whole = F.col(f"`{text}`").cast("string")
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(whole).alias("t0"), F.xxhash64(F.lit(1), whole).alias("t1")
    )
    return held.join(bad, ["t0", "t1"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
