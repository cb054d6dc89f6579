"""How the words of a source differ from those of the other sources of its language.

1. Terms are counted by document; each language keeps those of enough documents, with their places in byte order.
2. Every range of ``SHARD_TERMS`` neighbouring terms becomes a minimal acyclic transducer, built where the range lies.
3. Transducers go to all workers in packs of bounded size, and the texts are streamed through them: occurrences come
   out as (group, ordinal, count). One pack is the usual case; a larger vocabulary takes one pass over the texts of its
   languages for each pack, by the same code.
4. Shares are compared exactly in whole numbers, for pairs of sources in blocks: a block holds ``SIDE`` sources a side
   and ``CHUNK_TERMS`` terms, so a task's memory is bounded whatever the number of sources, terms and rows.

Only terms, ordinals and counts are shuffled, each counted within its task first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.llm.tokens import TERM, numbered, spans, strings
from linescope.llm.transducer import Transducer, build
from linescope.llm.words import LOWER, slices
from linescope.operators.ranking import value_rank
from linescope.session import materialise

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Terms of one transducer, and bytes of the transducers that are sent to the workers at a time.
SHARD_TERMS = 1 << 15
PACK_BYTES = 64 << 20
#: Rows that a task gathers before it hands them on.
GATHER = 1 << 20
#: Sources and terms of a block of the comparison.
SIDE, CHUNK_TERMS = 256, 4096


def _parts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    names = {"lang": lang, "source": source, "text": text}
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in names.items()])


class _Slices:
    """Slices of a batch as terms: row numbers, term numbers and the distinct terms."""

    def __init__(self, column: pa.Array) -> None:
        self.column = column

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
        for begin, end, data, at in slices(self.column):
            low, inside = LOWER[data], TERM[data]
            starts, ends, first = spans(inside, at)
            number, terms = numbered(strings(low, inside, starts, ends))
            yield begin, end, np.repeat(np.arange(end - begin), np.diff(first)), number, terms


def _merged(rows: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables(rows).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def _gathered(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows summed by key within the task, as far as ``GATHER`` rows allow."""
    held, total = [], 0
    for t in tables:
        held.append(t)
        total += len(t)
        if total > GATHER:
            whole = _merged(held, keys)
            held, total = [whole], len(whole)
            if total > GATHER // 2:  # few repeats: hand on
                yield from whole.to_batches()
                held, total = [], 0
    if held:
        yield from _merged(held, keys).to_batches()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tables() -> Iterator[pa.Table]:
        for batch in batches:
            kind, langs = numbered(batch.column(0))
            for begin, end, row, number, terms in _Slices(batch.column(1)):
                n = len(terms)
                pair = np.unique(row * n + number)  # a document counts a term once
                cell, count = np.unique(kind[begin:end][pair // n] * n + pair % n if n else pair, return_counts=True)
                if len(cell):
                    yield pa.table(
                        {"lang": langs.take(pa.array(cell // n)), "term": terms.take(pa.array(cell % n)), "n": count.astype(np.int64)}
                    )

    for batch in _gathered(tables(), ["lang", "term"]):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)], ["lang", "term", "n"])


def vocabulary(docs: DataFrame, text: str = "text", lang: str = "lang", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n_docs, ordinal): terms in at least ``min_docs`` documents of their language, numbered from 0 in
    byte order. Written in the shared folder."""
    found = _parts(docs, text, lang, lang).select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, n long")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    # Strings order by their bytes.
    terms = materialise(kept.withColumn("term", F.col("term").cast("string")), "terms")
    ranked = value_rank(terms, "term", part=["lang"], rank="ordinal")
    return materialise(ranked.select("lang", "term", "n_docs", F.col("ordinal").cast("long")), "vocabulary")


def _packed(table: pa.Table) -> pa.Table:
    table = table.sort_by("ordinal")
    terms = [t.encode() for t in table.column("term").to_pylist()]
    made = build(terms)
    return pa.table(
        {
            "lang": [table.column("lang")[0].as_py()],
            "offset": [table.column("ordinal")[0].as_py()],
            "low": [terms[0]],
            "high": [terms[-1]],
            "body": pa.array([pickle.dumps((made.root, made.final, made.keys, made.target, made.add))], pa.binary()),
        }
    )


def transducers(vocab: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, offset, low, high, body): one transducer for each ``shard_terms`` neighbouring terms of a language.

    Its ordinals count from ``offset``; ``low`` and ``high`` are its first and last term.
    """
    shard = F.floor(F.col("ordinal") / shard_terms).alias("shard")
    made = vocab.groupBy("lang", shard).applyInArrow(_packed, "lang string, offset long, low binary, high binary, body binary")
    return materialise(made, "transducers")


def _prefix(term: bytes) -> int:
    return int.from_bytes(term[:8].ljust(8, b"\0"), "big")


def _prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First eight bytes of every span as a number that orders like the spans."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        there = starts + k < ends
        byte = np.where(there, data[np.minimum(starts + k, max(len(data) - 1, 0))], 0).astype(np.uint64)
        out = (out << np.uint64(8)) | byte
    return out


def _recounted(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of a batch: language, group, text. A group is of one language."""
    shards: dict[str, list[tuple[int, int, int, Transducer]]] = {}
    for lang, offset, low, high, body in sent.value:
        shards.setdefault(lang, []).append((offset, _prefix(low), _prefix(high), Transducer(*pickle.loads(body))))

    def tables() -> Iterator[pa.Table]:
        for batch in batches:
            kind, langs = numbered(batch.column(0))
            origin, groups = numbered(batch.column(1))
            names = langs.to_pylist()
            for begin, end, row, number, terms in _Slices(batch.column(2)):
                n = len(terms)
                if not n:
                    continue
                of_group = np.zeros(len(groups), np.int64)
                of_group[origin] = kind
                cell, count = np.unique(origin[begin:end][row] * n + number, return_counts=True)
                cell_kind = of_group[cell // n]
                _, offsets, raw = terms.buffers()
                at = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + n + 1]
                data = np.frombuffer(raw, np.uint8)
                starts, ends = at[:-1], at[1:]
                prefix = _prefixes(data, starts, ends)
                for k in np.unique(cell_kind).tolist():
                    mine = np.flatnonzero(cell_kind == k)
                    which = np.unique(cell[mine] % n)
                    ordinal = np.full(n, -1, np.int64)
                    for offset, low, high, automaton in shards.get(names[k], ()):
                        near = which[(prefix[which] >= low) & (prefix[which] <= high)]
                        found = automaton.ordinals(data, starts[near], ends[near])
                        ordinal[near[found >= 0]] = found[found >= 0] + offset
                    told = ordinal[cell[mine] % n]
                    mine, told = mine[told >= 0], told[told >= 0]
                    yield pa.table({"group": groups.take(pa.array(cell[mine] // n)), "ordinal": told, "n": count[mine].astype(np.int64)})

    yield from _gathered(tables(), ["group", "ordinal"])


def _group(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "lang", F.lit(0), "source")


def group_salt(names: DataFrame) -> int:
    """Smallest salt that gives all (lang, source) rows different numbers."""
    salt = 0
    while names.groupBy(_group(salt)).count().where("count > 1").limit(1).count():
        salt += 1
    return salt


def recount(
    docs: DataFrame,
    automata: DataFrame,
    salt: int,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """(group, ordinal, n): occurrences of every term in every group that has some. Written in the shared folder.

    Groups are the numbers that ``salt`` gives to (lang, source); ordinals count within the language.
    """
    spark, schema = docs.sparkSession, "group long, ordinal long, n long"
    parts = _parts(docs, text, lang, source).select("lang", _group(salt).alias("group"), "text")
    written: list[DataFrame] = []

    def count(pack: list) -> None:
        sent = spark.sparkContext.broadcast(pack)
        mine = parts.where(F.col("lang").isin(sorted({p[0] for p in pack})))
        found = mine.mapInArrow(lambda batches: _recounted(sent, batches), schema)
        written.append(materialise(found.groupBy("group", "ordinal").agg(F.sum("n").alias("n")), "recount"))
        sent.destroy()

    pack, size = [], 0
    for r in automata.orderBy("lang", "offset").toLocalIterator():
        if pack and size + len(r["body"]) > pack_bytes:
            count(pack)
            pack, size = [], 0
        pack.append((r["lang"], r["offset"], bytes(r["low"]), bytes(r["high"]), bytes(r["body"])))
        size += len(r["body"])
    if pack:
        count(pack)
    out = spark.createDataFrame([], schema)
    for part in written:  # packs hold different terms
        out = out.union(part)
    return out


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) in whole numbers of any length."""
    scaled = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, total.cast("decimal(20,0)")) + 1


def _square(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _compared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums of a block: every source of one side against every source of the other, both ways."""
    lang, lo, hi, chunk = (k.as_py() for k in key)
    sid, ordinal, p, size = (table.column(c).to_numpy() for c in ("sid", "ordinal", "p", "size"))
    none = ordinal < 0  # the share of a term that a source lacks
    sids = np.sort(sid[none])
    width = int(min(CHUNK_TERMS, size[0] - chunk * CHUNK_TERMS))
    shares = np.empty((len(sids), width), np.int64)
    shares[np.searchsorted(sids, sid[none])] = p[none][:, None]
    shares[np.searchsorted(sids, sid[~none]), ordinal[~none] - chunk * CHUNK_TERMS] = p[~none]
    side = sids // SIDE
    rows = []
    for a in np.flatnonzero(side == lo):
        others = np.flatnonzero(side == hi)
        others = others[others > a]
        gap = shares[a] - shares[others]
        gap *= gap
        rows.append((np.full(len(others), sids[a]), sids[others], (gap // shares[others]).sum(axis=1)))
        rows.append((sids[others], np.full(len(others), sids[a]), (gap // shares[a]).sum(axis=1)))
    a, b, value = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(3))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "value": value})


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, a, b, value): divergence of source number ``a`` from ``b`` of the same language."""
    blocks = groups.groupBy("lang").agg((F.max(F.col("sid")) / SIDE).cast("long").alias("last"))
    chunks = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("size") - 1, F.lit(CHUNK_TERMS)))
    none = groups.where("size > 0").select(
        "lang", "sid", F.lit(-1).cast("long").alias("ordinal"), F.col("none").alias("p"), "size", F.explode(chunks).alias("chunk")
    )
    held = cells.select("lang", "sid", "ordinal", "p", "size", F.call_function("div", F.col("ordinal"), F.lit(CHUNK_TERMS)).alias("chunk"))
    block = F.call_function("div", F.col("sid"), F.lit(SIDE))
    every = none.unionByName(held).join(blocks, "lang")
    dealt = every.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select(
        "lang", F.least(block, "other").alias("lo"), F.greatest(block, "other").alias("hi"), "chunk", "sid", "ordinal", "p", "size"
    )
    sums = dealt.groupBy("lang", "lo", "hi", "chunk").applyInArrow(_compared, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    shard_terms: int = SHARD_TERMS,
    pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group.

    Part ``pair``: every other source of the language and the divergence from it; part ``term``: the ``top_terms`` terms
    that stand out most against the language. Ranks count from 1 by falling value; equal values follow the ordinals of
    terms, which is their byte order, and the bytes of source names.

    A null text, language or source is the empty string, so null and empty are one group. A group without terms has
    pairs and no terms; a language without kept terms has pairs of value 0; a source alone in its language has no pairs.
    Repeated rows are documents of their own. An empty table gives an empty result. Extra columns are not read.
    """
    vocab = vocabulary(docs, text, lang, min_docs)
    names = materialise(_parts(docs, text, lang, source).select("lang", "source").distinct(), "groups")
    salt = group_salt(names)
    counts = recount(docs, transducers(vocab, shard_terms), salt, text, lang, source, pack_bytes)
    sizes = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    named = names.withColumn("group", _group(salt)).join(totals, "group", "left").join(sizes, "lang", "left").na.fill(0, ["total", "size"])
    whole = F.col("total") + F.col("size")
    ranked = value_rank(materialise(named, "groups"), "source", part=["lang"], rank="sid")
    groups = materialise(ranked.withColumn("none", F.when(whole > 0, _share(F.lit(0), whole))), "groups")
    cells = materialise(
        counts.join(groups.select("group", "lang", "source", "sid", "total", "size"), "group")
        .withColumn("p", _share(F.col("n"), whole))
        .select("lang", "source", "sid", "ordinal", "n", "p", "size"),
        "cells",
    )

    others = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("b"))
    skeleton = groups.select("lang", "source", F.col("sid").alias("a")).join(others, "lang").where("a <> b")
    pairs = skeleton.join(_pairs(groups, cells), ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_item).alias("rank"))

    spoken = groups.groupBy("lang").agg((F.sum("total") + F.max("size")).alias("whole"))
    whole_lang = cells.groupBy("lang", "ordinal").agg(F.sum("n").alias("all")).join(spoken, "lang")
    q = whole_lang.select("lang", "ordinal", _share(F.col("all"), F.col("whole")).alias("q"))
    stands = cells.join(q, ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", _square(F.col("p"), F.col("q")).alias("value"))
    by_term = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    top = stands.withColumn("rank", F.row_number().over(by_term)).where(F.col("rank") <= top_terms)
    terms = top.join(vocab.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank"
    )
    return pairs.union(terms)
