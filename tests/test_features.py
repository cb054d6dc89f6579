"""Features that are counted and looked up inside the row: brute-force checks, repeated keys and plans."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linescope.functions import grams as G
from linescope.functions import text as T
from linescope.operators import embeddings as E
from linescope.operators import features as X

KEYED = [(1, "aa bb aa bb aa"), (2, "cc"), (2, "aa bb cc"), (None, "dd ee"), (None, "dd"), (3, ""), (4, None)]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def grams(words, n):
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def docs(seed=4, n=60):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    return [(i, " ".join(rnd.choice(words[: rnd.randint(2, 20)]) for _ in range(rnd.randint(0, 30)))) for i in range(n)]


def test_ngram_profile_counts_the_rows_of_a_key_together(spark):
    df = spark.createDataFrame(KEYED, "key long, code string")
    got = {(r[0], r[1]): tuple(r)[2:] for r in X.ngram_profile(df, T.chunk_tokens(F.col("code")), 3).collect()}
    want = {}
    for key in (1, 2, None, 3, 4):
        for n in (1, 2, 3):
            found = [g for k, t in KEYED if k == key and t for g in grams(t.split(), n)]
            if found:
                want[key, n] = (len(found), len(set(found)), min(found), max(found))
    assert got == want


def test_ngram_profile_of_single_rows_moves_no_ngram(spark):
    df = spark.createDataFrame(docs(), "key long, code string")
    out = X.ngram_profile(df, T.chunk_tokens(F.col("code")), 4)
    assert "Exchange hashpartitioning" not in final_plan(out)


@pytest.mark.parametrize("block", [7, 250_000])
def test_frequent_ngrams_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK_TERMS", block)
    data = docs()
    df = spark.createDataFrame(data, "key long, code string")
    seen = Counter(g for _, t in data for g in {g for n in (1, 2, 3, 4) for g in grams(t.split(), n)})
    for low in (1, 3, 4.5):
        found = X.frequent_ngrams(df, T.chunk_tokens(F.col("code")), 4, low)
        assert {r["term"]: r["df"] for part in found for r in part.collect()} == {g: c for g, c in seen.items() if c >= low}


@pytest.mark.parametrize("config", [5, 8])
def test_weights_look_up_terms_where_they_are(spark, monkeypatch, config):
    monkeypatch.setattr(X, "MIN_SHARE", 0.1)
    data = [*docs(), (None, "wax wax"), (7, "wax wbx")]
    df = spark.createDataFrame(data, "key long, code string")
    per_row = [(k, Counter(g for n in (1, 2, 3, 4) for g in grams(t.split(), n))) for k, t in data]
    seen = Counter(g for _, c in per_row for g in c)
    kept = {g: math.log((len(data) + 1) / (c + 1)) + 1 for g, c in seen.items() if c >= 0.1 * len(data)}
    raw = [(k, g, tf * (kept[g] if config == 8 else 1)) for k, c in per_row for g, tf in c.items() if g in kept]
    square = Counter()
    for k, _, w in raw:
        square[k] += w * w
    want = sorted((k, g, round(w / math.sqrt(square[k]), 9)) for k, g, w in raw if k is not None) if config == 8 else raw
    for block in (5, 250_000):
        monkeypatch.setattr(X, "BLOCK_TERMS", block)
        out = X.configured_features(df, config)
        got = [(r["key"], r["term"], r["weight"]) for r in out.collect()]
        if config == 8:
            assert sorted((k, g, round(w, 9)) for k, g, w in got) == want
        else:
            assert Counter(got) == Counter(want)
        assert "hashpartitioning(term" not in final_plan(out)


def test_subwords_of_repeated_keys_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(X, "MIN_CHAR_DOCUMENTS", 2)
    data = [(1, "abcab abc"), (2, "abcx"), (2, "zabc"), (None, "qqq"), (None, "qqqab"), (5, "qqq " * 9), (6, None), (7, "")]
    df = spark.createDataFrame(data, "key long, code string")
    chars = Counter((k, t[i : i + n]) for k, t in data if t for n in range(2, 7) for i in range(len(t) - n + 1))
    seen = Counter(g for k, g in chars if len(g) > 2)
    sub = {g.strip() for g, c in seen.items() if c >= 2}
    sub = {g for g in sub if len(g) > 1 and " " not in g}
    want = {(k, g, c) for (k, g), c in chars.items() if g in sub}
    for piece, block in ((1 << 16, 250_000), (6, 3)):
        monkeypatch.setattr(X, "PIECE", piece)
        monkeypatch.setattr(X, "BLOCK_TERMS", block)
        out = X.subword_features(df).where("block = 'char'").select("key", "term", "tf")
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want


def test_pooling_is_a_plain_sum_per_dimension(spark):
    counts = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "zz", 4)], "key long, term string, tf long")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [5.0, 0.0])], "term string, vector array<double>")
    out = E.mean_pool(spark.createDataFrame([(1,), (2,)], "key long"), counts, vectors, 2)
    assert {r["key"]: r["vector"] for r in out.collect()} == {1: [2.0, 1.5], 2: [0.0, 0.0]}
    plan = final_plan(out)
    assert "ObjectHashAggregate" not in plan and "hashpartitioning(term" not in plan


def test_null_vectors_count_as_zeros(spark):
    counts = spark.createDataFrame([(1, "a", 3), (1, "n", 1), (2, "n", 4)], "key long, term string, tf long")
    vectors = spark.createDataFrame([("a", [4.0, None]), ("n", None)], "term string, vector array<double>")
    out = E.mean_pool(spark.createDataFrame([(1,), (2,)], "key long"), counts, vectors, 2)
    assert {r["key"]: r["vector"] for r in out.collect()} == {1: [3.0, 0.0], 2: [0.0, 0.0]}


def test_terms_of_a_side_are_looked_up_where_they_are(spark):
    df = spark.createDataFrame([(1, "ab ab cd", "cd"), (2, "", "zz")], "key long, prev_data string, cur_data string")
    vocab = spark.createDataFrame([("ab", 0), ("cd", 1)], "term string, term_id int")
    vectors = spark.createDataFrame([("ab", [1.0]), ("cd", [4.0])], "term string, vector array<double>")
    out = E.change_features(df, vectors, vocab, 1, 2)
    assert {tuple(r) for r in out.where("feature_id > 1").collect()} == {(1, 2, 2.0), (1, 3, 1.0), (1, 5, 1.0)}
    assert "hashpartitioning(term" not in final_plan(out)
    sides = E.side_counts(df, vocab)
    assert {tuple(r) for r in sides.collect()} == {(1, "prev", "ab", 2), (1, "prev", "cd", 1), (1, "cur", "cd", 1), (2, "prev", None, None)}
    assert "hashpartitioning(term" not in final_plan(sides)


ODD = ["", "a", "abcabcab", "ab\0", "\0\0\0ab\0", "é中é中é中\U0001f600\U0001f600 é", "AbC  ab\n\nc", "x y " * 9, "ab\0", "\U0001f600" * 7]


@pytest.mark.parametrize("limit", [1 << 62, 1])
def test_grams_of_a_slice_are_exact(limit):
    from linescope.functions import grams as G

    got = Counter()
    for terms, counts in G.distinct_grams(ODD, 1, 6, limit):
        got.update(dict(zip(terms.to_pylist(), counts.tolist(), strict=True)))
    assert got == Counter(g for t in ODD for g in {t[i : i + n] for n in range(1, 7) for i in range(len(t) - n + 1)})


@pytest.mark.parametrize("size", [1, 12, 1 << 22])
def test_slices_add_up_to_all_texts(size):
    import pyarrow as pa

    from linescope.functions import grams as G

    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["t"]) for part in ([*ODD, None], ODD[5:7], [])]
    got = Counter()
    for batch in G.count_grams(3, 6, size)(iter(batches)):
        got.update(dict(zip(*batch.to_pydict().values(), strict=True)))
    assert got == Counter(g for t in [*ODD, *ODD[5:7]] for g in {t[i : i + n] for n in range(3, 7) for i in range(len(t) - n + 1)})


def test_character_vocabulary_holds_no_strings_of_a_text(spark):
    """The n-grams of a text are no column of the plan; the counts are those of the plain expressions."""
    data = [(i, t) for i, t in enumerate([*ODD, None, *ODD] * 5)]
    df = spark.createDataFrame(data, "key long, code string")
    got = X.char_vocabulary(df)
    want = X.document_frequency(df, X.char_terms(3, 6)).where("df >= 10")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    assert "regexp_extract_all" not in final_plan(got)


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_runs_of_words_are_looked_at_where_shorter_runs_are_known(most):
    texts = [t.split() for _, t in docs(9, 40)] + [[], ["wax"]]
    lists = pa.array([*texts, None], pa.list_(pa.string()))
    seen = Counter(g for t in texts for g in {g for n in (1, 2, 3) for g in grams(t, n)})
    known = [pa.array([g for g, c in seen.items() if c >= 4 and g.count(" ") == n], pa.string()) for n in range(3)]
    got, looked = Counter(), set()
    for first, _, words, sizes in G.word_slices(lists, most):
        for rows, ranks, terms in G.known_runs(words, sizes, known, 3):
            looked.update(terms.to_pylist())
            got.update((first + r, terms[k].as_py()) for r, k in zip(rows.tolist(), ranks.tolist(), strict=True))
    want = Counter((i, g) for i, t in enumerate(texts) for n in (1, 2, 3) for g in grams(t, n) if seen[g] >= 4)
    assert got == want and len(looked) < len(seen)
    for _, _, words, sizes in G.word_slices(lists, most):
        every = [len(rows) for rows, _, _ in G.known_runs(words, sizes, [None, None], 3)]
        assert every == [int(sum(max(0, s - n) for s in sizes)) for n in range(3)]
