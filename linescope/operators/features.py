"""Terms, vocabularies and weights as long tables ``(key, term, ...)``.

``key`` names one document, which is one row. Its terms are counted inside the row, so counts need no shuffle; only
``term`` moves, where documents are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.functions import text as T
from linescope.functions.grams import count_grams, count_run_texts, count_runs
from linescope.functions.rows import exploded, inlined
from linescope.functions.text import bind
from linescope.operators.ranking import value_rank
from linescope.session import materialise, small_side

MAX_FEATURES = 10_000
MIN_CHAR_DOCUMENTS = 10
PIECE = 1 << 16  # characters of a text that one row of n-grams comes from
BLOCK_TERMS = 250_000  # terms of a vocabulary that are broadcast together


def by_repetition(df: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows whose key stands on one row, and the others; only keys move to find them. NULL is a key as well."""
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_again"))
    held = small_side(again, "repeated-keys")
    same = F.col(key).eqNullSafe(F.col("_again"))
    return df.join(held, same, "left_anti"), df.join(held, same, "left_semi")


def term_counts(df: DataFrame, terms: Column, key: str = "key") -> DataFrame:
    """(key, term, tf) from an array of terms per row: runs of the sorted terms, a projection."""

    def runs(ordered: Column) -> Column:
        places = F.filter(
            F.transform(ordered, lambda _, i: i),
            lambda i: (i == 0) | (F.get(ordered, F.greatest(i - 1, F.lit(0))) != F.get(ordered, i)),
        )
        return bind(
            lambda at: F.transform(
                at,
                lambda place, k: F.struct(
                    F.get(ordered, place).alias("term"),
                    (F.coalesce(F.get(at, k + 1), F.size(ordered)) - place).cast("bigint").alias("tf"),
                ),
            ),
            places,
        )

    held = F.array_sort(F.array_compact(terms))
    return inlined(df, [F.col(key).alias("key")], bind(runs, held), "term")


def ngram_profile(df: DataFrame, words: Column, max_n: int, key: str = "key") -> DataFrame:
    """(key, n, grams, distinct_grams, first_gram, last_gram) of the word n-grams of every key, by length.

    A key on one row is profiled inside that row; the n-grams of other keys are counted together.
    """
    single, shared = by_repetition(df, key)

    def profile(n: int) -> Column:
        return bind(
            lambda terms: F.struct(
                F.lit(n).alias("n"),
                F.size(terms).cast("bigint").alias("grams"),
                F.size(F.array_distinct(terms)).cast("bigint").alias("distinct_grams"),
                F.array_min(terms).alias("first_gram"),
                F.array_max(terms).alias("last_gram"),
            ),
            T.word_ngrams(F.col("_words"), n, n),
        )

    def worded(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).alias("key"), words.alias("_words"))

    inside = inlined(worded(single), ["key"], F.array(*[profile(n) for n in range(1, max_n + 1)]), "first_gram")
    sized = F.array(
        *[F.struct(F.lit(n).alias("n"), T.word_ngrams(F.col("_words"), n, n).alias("terms")) for n in range(1, max_n + 1)]
    )
    rows = exploded(inlined(worded(shared), ["key"], sized, "n"), ["key", "n"], F.col("terms"), "term")
    once = rows.groupBy("key", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    together = once.groupBy("key", "n").agg(
        F.sum("tf").alias("grams"),
        F.count(F.lit(1)).alias("distinct_grams"),
        F.min("term").alias("first_gram"),
        F.max("term").alias("last_gram"),
    )
    return inside.unionByName(together)


def corpus_frequency(df: DataFrame, terms: Column) -> DataFrame:
    """(term, freq) over the whole corpus."""
    return exploded(df, [], terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def document_frequency(df: DataFrame, terms: Column) -> DataFrame:
    """(term, df) with one row per document: repeats go inside the row, so only ``term`` shuffles."""
    return exploded(df, [], F.array_distinct(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def top_vocabulary(counts: DataFrame, limit: int = MAX_FEATURES) -> DataFrame:
    """(term, freq, term_id): the ``limit`` most frequent terms, ids in term order.

    Ties at the edge go to the smaller term. At most ``limit`` rows reach the id window.
    """
    top = (
        counts.groupBy("term").agg(F.sum("tf").alias("freq")).orderBy(F.col("freq").desc(), "term").limit(limit)
    )
    return top.withColumn("term_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).cast("int"))


def frequent_terms(frequency: DataFrame, docs: DataFrame | None = None, min_share: float = 0.0, min_count: int = 1) -> DataFrame:
    """(term, df): terms found in at least ``min_count`` documents or that share of ``docs``."""
    out = frequency.where(F.col("df") >= min_count)
    if docs is not None and min_share > 0:
        n = docs.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
        out = out.where(F.col("df") >= F.lit(min_share) * n)
    return out


def df_vocabulary(counts: DataFrame, docs: DataFrame | None = None, min_share: float = 0.0, min_count: int = 1) -> DataFrame:
    """The same from counts that are needed anyway."""
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return frequent_terms(frequency, docs, min_share, min_count)


def with_term_ids(vocab: DataFrame, offset: int = 0) -> DataFrame:
    """Ids 0.. in term order for a vocabulary of any size."""
    return value_rank(vocab, "term", rank="term_id").withColumn("term_id", F.col("term_id") + offset)


def use_vocabulary(counts: DataFrame, vocab: DataFrame, limit: int | None = None) -> DataFrame:
    """Keep terms of a fitted vocabulary and add its columns.

    With a ``limit`` the vocabulary is written once and broadcast if it was counted to be small; all its terms are kept in
    any case. Without one the join is left to the optimizer, which broadcasts by measured size only.
    """
    side = small_side(vocab, "vocabulary") if limit is not None else vocab
    return counts.join(side, "term")


def in_blocks(vocab: DataFrame, limit: int | None = None) -> list[DataFrame]:
    """A written vocabulary in parts of about ``limit`` terms, by the hash of the term."""
    blocks = max(1, -(-vocab.count() // (limit or BLOCK_TERMS)))
    return [vocab] if blocks == 1 else [vocab.where(_block("term", blocks) == i) for i in range(blocks)]


def _block(term: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(blocks))


def look_up(counts: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """``counts`` joined to a vocabulary of any size that comes in blocks.

    Every block is broadcast and passed by all rows, so the terms of the texts never move; each block is one pass.
    """
    out = None
    for i, block in enumerate(blocks):
        rows = counts if len(blocks) == 1 else counts.where(_block("term", len(blocks)) == i)
        part = rows.join(F.broadcast(block), "term")
        out = part if out is None else out.unionByName(part)
    return out


def non_empty_rows(df: DataFrame, features: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``df`` that have at least one feature."""
    return df.join(features.select("key").distinct().withColumnRenamed("key", key), key, "left_semi")


@dataclass(frozen=True)
class Weighting:
    """Term weighting of one configuration."""

    max_n: int
    idf: bool


# Longest word n-gram and use of idf with row norm, per configuration.
CONFIGS = {
    1: Weighting(1, False),
    2: Weighting(1, True),
    3: Weighting(2, False),
    4: Weighting(3, False),
    5: Weighting(4, False),
    6: Weighting(2, True),
    7: Weighting(3, True),
    8: Weighting(4, True),
}
MIN_SHARE = 0.001


def frequent_ngrams(docs: DataFrame, chunks: Column, max_n: int, min_df: float) -> list[DataFrame]:
    """(term, df) of the word n-grams in at least ``min_df`` rows, a written table per length.

    A row that holds a run of n words holds its first and its last n - 1 as well, so a run can only be frequent if both
    are: the others are left out before they are counted. Only what is left moves. Words hold no blank.
    """
    words = docs.select(chunks.alias("words"))
    found: list[DataFrame] = []
    known: list = []
    for n in range(1, max_n + 1):
        parts = words.mapInArrow(count_run_texts(known, n), "term string, df bigint")
        found.append(materialise(_summed(parts).where(F.col("df") >= min_df), "ngrams"))
        known.append(_sent(found[-1]))
    return found


def _sent(terms: DataFrame):
    """The written terms on every worker; None where they are more than a block, which leaves nothing out."""
    if terms.count() > BLOCK_TERMS:
        return None
    held = terms.select("term").toArrow()["term"].combine_chunks().cast(pa.string())
    return terms.sparkSession.sparkContext.broadcast(held)


def run_counts(df: DataFrame, words: Column, max_n: int, known: list, key: str = "key") -> DataFrame:
    """(key, term, tf) of the known runs of words of every row, counted where the row is; None in ``known`` stands for all."""
    rows = df.select(F.col(key).alias("key"), words.alias("words"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count_runs(known, max_n), f"key {kind}, term string, tf bigint")


def configured_features(df: DataFrame, config: int, key: str = "key", code: str = "code", fit_on: DataFrame | None = None) -> DataFrame:
    """Weighted chunk n-grams of one configuration; vocabulary and idf come from ``fit_on``.

    A vocabulary of terms in a share of the texts is bounded by the length of the texts, so it is broadcast and the
    n-grams of a text never move. Norms meet the texts before they are cut into terms.
    """
    setting = CONFIGS[config]
    chunks = T.chunk_tokens(F.coalesce(F.col(code), F.lit("nan")))
    train = df if fit_on is None else fit_on
    n = float(train.count())
    fitted = frequent_ngrams(train, chunks, setting.max_n, MIN_SHARE * n)
    vocab = fitted[0]
    for longer in fitted[1:]:
        vocab = vocab.unionByName(longer)
    known = [_sent(terms) for terms in fitted]
    idf = F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0
    blocks = in_blocks(vocab.select("term", idf.alias("idf")))
    if not setting.idf:
        return look_up(run_counts(df, chunks, setting.max_n, known, key), blocks).select("key", "term", F.col("tf").cast("double").alias("weight"))
    raw = F.col("tf") * F.col("idf")
    norm = look_up(run_counts(df, chunks, setting.max_n, known, key), blocks).groupBy("key").agg(F.sqrt(F.sum(raw * raw)).alias("norm"))
    normed = df.join(norm.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"))
    counts = run_counts(normed.withColumn("_doc", F.struct(F.col(key).alias("key"), "norm")), chunks, setting.max_n, known, "_doc")
    return look_up(counts, blocks).select("key.key", "term", (raw / F.col("key.norm")).alias("weight"))


def char_terms(min_n: int, max_n: int, code: str = "code") -> Column:
    """Character n-grams of the whole folded text."""
    return T.char_ngrams(T.fold_text(F.col(code)), min_n, max_n)


def char_vocabulary(df: DataFrame, min_n: int = 3, max_n: int = 6, min_count: int = MIN_CHAR_DOCUMENTS, code: str = "code") -> DataFrame:
    """(term, df) of character n-grams found in at least ``min_count`` documents."""
    return frequent_terms(_summed(char_document_frequency(df, min_n, max_n, code)), min_count=min_count)


def char_document_frequency(df: DataFrame, min_n: int, max_n: int, code: str = "code") -> DataFrame:
    """(term, df) with one row per document, in parts: a term stands once for every slice of texts that holds it.

    N-grams are numbers until the texts of a slice are counted together, so no row holds them as strings and only terms
    with their counts leave the task.
    """
    folded = df.select(T.fold_text(F.col(code)).alias("folded"))
    return folded.mapInArrow(count_grams(min_n, max_n), "term string, df bigint")


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def char_counts(df: DataFrame, min_n: int, max_n: int, key: str = "key", code: str = "code") -> DataFrame:
    """(key, term, tf): character n-gram counts per document over the whole folded text.

    The text is cut into overlapping pieces, one row each, so no row holds the n-grams of a long text; they are counted
    with map-side combine. An n-gram belongs to the piece that it starts in.
    """
    return _piece_terms(df, min_n, max_n, key, code).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def _piece_terms(df: DataFrame, min_n: int, max_n: int, key: str, code: str) -> DataFrame:
    """(key, term) of every character n-gram, from overlapping pieces."""

    def pieces(t: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / PIECE).cast("int") - 1, F.lit(0)))
        return F.transform(at, lambda i: F.substr(t, i * PIECE + 1, F.lit(PIECE + max_n - 1)))

    rows = exploded(df, [F.col(key).alias("key")], bind(pieces, T.fold_text(F.col(code))), "piece")
    grams = F.concat(
        *[T.char_ngrams(F.substr("piece", F.lit(1), F.lit(PIECE + n - 1)), n, n) for n in range(min_n, max_n + 1)]
    )
    return exploded(rows, ["key"], grams, "term")


def subword_vocabulary(char_vocab: DataFrame) -> DataFrame:
    """Stripped n-grams with exactly one non-blank run, longer than one character."""
    bare = F.regexp_replace("term", "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")
    return (
        char_vocab.select(bare.alias("term"))
        .where((F.length("term") > 1) & ~F.col("term").rlike("(?U)[\\s\\x1c-\\x1f]"))
        .distinct()
    )


def minus_terms(vocab: DataFrame, other: DataFrame) -> DataFrame:
    """Vocabulary without the terms of another one."""
    return vocab.join(other.select("term"), "term", "left_anti")


def _by_length(df: DataFrame, key: str, code: str) -> tuple[DataFrame, DataFrame]:
    """Rows that hold all n-grams of their key and are one piece, and the others."""
    single, shared = by_repetition(df.select(F.col(key).alias("key"), F.col(code).alias("code")))
    short = F.coalesce(F.length("code") <= PIECE, F.lit(True))
    return single.where(short), single.where(~short).unionByName(shared)


def subword_features(df: DataFrame, key: str = "key", code: str = "code", fit_on: DataFrame | None = None) -> DataFrame:
    """(key, block, term, tf): word counts beside sub-word counts.

    Words are the top vocabulary without the sub-words; sub-words are looked up with lengths 2..6. The n-grams of a short
    text are counted in its row and looked up where they are; those of long texts and repeated keys are added up behind
    the look-up.
    """
    train = df if fit_on is None else fit_on
    words = term_counts(df, T.code_tokens(F.col(code)), key)
    train_words = words if fit_on is None else term_counts(train, T.code_tokens(F.col(code)), key)
    one, many = _by_length(df, key, code)
    train_one, train_many = (one, many) if fit_on is None else _by_length(train, key, code)
    counted_apart = char_counts(train_many, 3, 6).select("term", F.lit(1).cast("bigint").alias("df"))
    frequency = _summed(char_document_frequency(train_one, 3, 6).unionByName(counted_apart))
    sub = materialise(subword_vocabulary(frequent_terms(frequency, min_count=MIN_CHAR_DOCUMENTS)), "sub-words")
    word_vocab = minus_terms(top_vocabulary(train_words).select("term"), sub)
    word_rows = use_vocabulary(words, word_vocab, MAX_FEATURES).select("key", F.lit("word").alias("block"), "term", "tf")
    # Lengths 2..6 are exactly the lengths a kept sub-word can have.
    blocks = in_blocks(sub)
    summed = look_up(_piece_terms(many, 2, 6, "key", "code"), blocks).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = look_up(term_counts(one, char_terms(2, 6)), blocks).select("key", "term", "tf").unionByName(summed)
    return word_rows.unionByName(counted.select("key", F.lit("char").alias("block"), "term", "tf"))


def concat_blocks(blocks: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, feature_id, value) from (rows with term and value, vocabulary) per block.

    Ids follow term order inside a block and block order overall.
    """
    out, shift = None, F.lit(0).cast("bigint")
    for rows, terms in blocks:
        # Read by the ids, their cut points and the offset of the next block.
        vocab = materialise(terms.select("term"), "vocabulary")
        ids = with_term_ids(vocab)
        part = rows.join(ids, "term").select("key", (F.col("term_id") + shift).alias("feature_id"), "value")
        out = part if out is None else out.unionByName(part)
        shift = shift + vocab.agg(F.count(F.lit(1)).alias("n")).scalar()
    return out


def most_common(df: DataFrame, tokens: Column, key: str = "key") -> DataFrame:
    """Most common element per row, first seen on ties."""
    counted = (
        exploded(df, [F.col(key).alias("key")], tokens, "term", "pos")
        .groupBy("key", "term")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    )
    return counted.groupBy("key").agg(
        F.max_by("term", F.struct(F.col("n"), -F.col("first_pos"))).alias("term"), F.max("n").alias("n")
    )
