"""Section D: tokens, vocabularies, weights and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from linescope import session
from linescope.functions import text as T
from linescope.functions.rows import exploded
from linescope.functions.vectors import parse_vector
from linescope.operators import embeddings as E
from linescope.operators import features as X
from linescope.plans import inputs as I
from linescope.plans.registry import query

_CODE = T.CODE_TOKEN.replace("'", "''")
_CHUNK = T.CHUNK

TOKENS = f"""tokens as (select doc_id as key, unnest(regexp_extract_all(text, '{_CODE}')) as term from documents)"""
COUNTS = TOKENS + ", counts as (select key, term, count(*) as tf from tokens group by key, term)"
TOP = COUNTS + f""",
top as (select term, freq, cast(row_number() over (order by term) - 1 as int) as term_id from (
  select term, cast(sum(tf) as bigint) as freq from counts group by term order by freq desc, term limit {X.MAX_FEATURES}))"""
CHUNKS = f"""chunks as (select doc_id as key,
  list_filter(regexp_extract_all(lower(text), '{_CHUNK}'), lambda t: t <> 'aka') as toks from documents)"""


def _grams(max_n: int) -> str:
    lead = ", ".join(f"lead(t1, {i}) over w as t{i + 1}" for i in range(1, max_n)) or "null as none"
    parts = [
        f"select key, {n} as n, {" || ' ' || ".join(f't{i}' for i in range(1, n + 1))} as term from near where t{n} is not null"
        for n in range(1, max_n + 1)
    ]
    return CHUNKS + f""", placed as (select key, generate_subscripts(toks, 1) as pos, unnest(toks) as t1 from chunks),
near as (select key, t1, {lead} from placed window w as (partition by key order by pos)),
grams as (""" + " union all ".join(parts) + ")"


@query("d01_code_tokens", f"with {TOKENS} select term, count(*) as freq from tokens group by term")
def d01(spark, sf):
    return X.corpus_frequency(I.documents(spark, sf), T.code_tokens(F.col("code")))


@query("d02_chunk_tokens", f"with {CHUNKS} select term, count(*) as freq from (select unnest(toks) as term from chunks) group by term")
def d02(spark, sf):
    return X.corpus_frequency(I.documents(spark, sf), T.chunk_tokens(F.col("code")))


@query("d03_word_ngrams", f"""with {_grams(4)}
select key, n, count(*) as grams, count(distinct term) as distinct_grams, min(term) as first_gram, max(term) as last_gram
from grams group by key, n""")
def d03(spark, sf):
    return X.ngram_profile(I.documents(spark, sf), T.chunk_tokens(F.col("code")), 4)


def _counts(spark, sf):
    return X.term_counts(I.documents(spark, sf), T.code_tokens(F.col("code")))


@query("d04_code_term_counts", f"with {TOP} select c.key, t.term_id, c.term, c.tf from counts c join top t on t.term = c.term")
def d04(spark, sf):
    counts = _counts(spark, sf)
    vocab = X.top_vocabulary(counts).select("term", "term_id")
    return X.use_vocabulary(counts, vocab, X.MAX_FEATURES).select("key", "term_id", "term", "tf")


@query("d05_df_vocabulary", f"""with {_grams(1)},
df as (select term, count(distinct key) as df from grams group by term)
select term, df from df where df >= 0.001e0 * (select count(*) from documents)""")
def d05(spark, sf):
    docs = I.documents(spark, sf)
    return X.frequent_terms(X.document_frequency(docs, T.chunk_tokens(F.col("code"))), docs, X.MIN_SHARE)


CUTTING_SHARE = 0.02


@query("d05_df_vocabulary_common", f"""with {_grams(1)},
df as (select term, count(distinct key) as df from grams group by term)
select term, df from df where df >= {CUTTING_SHARE}e0 * (select count(*) from documents)""")
def d05_common(spark, sf):
    """A share that most terms do not reach."""
    docs = I.documents(spark, sf)
    return X.frequent_terms(X.document_frequency(docs, T.chunk_tokens(F.col("code"))), docs, CUTTING_SHARE)


def _weights_sql(max_n: int, idf: bool) -> str:
    head = f"""with {_grams(max_n)}, counts as (select key, term, count(*) as tf from grams group by key, term),
df as (select term, count(*) as df from counts group by term
       having count(*) >= 0.001e0 * (select count(*) from documents)),
n as (select cast(count(*) as double) as n from documents),
raw as (select c.key, c.term, c.tf, {"c.tf * (ln((1e0 + n.n) / (1e0 + d.df)) + 1e0)" if idf else "cast(c.tf as double)"} as w
        from counts c join df d on d.term = c.term, n),
"""
    scale = "sqrt(sum(w * w) over (partition by key))" if idf else "1e0"
    return head + f"weighted as (select key, term, w / {scale} as weight from raw)"


@query("d06_weights_config1", _weights_sql(1, False) + " select key, term, round(weight, 6) as weight from weighted")
def d06_1(spark, sf):
    out = X.configured_features(I.documents(spark, sf), 1)
    return out.select("key", "term", F.round("weight", 6).alias("weight"))


@query("d06_weights_config2", _weights_sql(1, True) + " select key, term, round(weight, 6) as weight from weighted")
def d06_2(spark, sf):
    out = X.configured_features(I.documents(spark, sf), 2)
    return out.select("key", "term", F.round("weight", 6).alias("weight"))


_PER_DOC = """ select key, count(*) as n_terms, round(sum(weight), 5) as total, round(max(weight), 6) as largest
 from weighted group by key"""


def _per_doc(features):
    return features.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.round(F.sum("weight"), 5).alias("total"),
        F.round(F.max("weight"), 6).alias("largest"),
    )


@query("d06_weights_config3", _weights_sql(2, False) + _PER_DOC)
def d06_3(spark, sf):
    return _per_doc(X.configured_features(I.documents(spark, sf), 3))


@query("d06_weights_config4", _weights_sql(3, False) + _PER_DOC)
def d06_4(spark, sf):
    return _per_doc(X.configured_features(I.documents(spark, sf), 4))


@query("d06_weights_config6", _weights_sql(2, True) + _PER_DOC)
def d06_6(spark, sf):
    return _per_doc(X.configured_features(I.documents(spark, sf), 6))


@query("d06_weights_config7", _weights_sql(3, True) + _PER_DOC)
def d06_7(spark, sf):
    return _per_doc(X.configured_features(I.documents(spark, sf), 7))


@query("d06_weights_config5", _weights_sql(4, False) + _PER_DOC)
def d06_5(spark, sf):
    return _per_doc(X.configured_features(I.documents(spark, sf), 5))


@query("d06_weights_config8", _weights_sql(4, True) + _PER_DOC)
def d06_8(spark, sf):
    return _per_doc(X.configured_features(I.documents(spark, sf), 8))


# Vocabulary fitted on labelled documents, applied to the others.
_FIT = COUNTS + f""", fitted as (select term, cast(row_number() over (order by term) - 1 as int) as term_id from (
  select term, sum(tf) as freq from counts semi join labels on doc_id = key group by term
  order by freq desc, term limit {X.MAX_FEATURES}))"""


def _labelled(spark, sf):
    docs = I.documents(spark, sf)
    ids = I.table(spark, sf, "labels").select(F.col("doc_id").alias("key"))
    return docs, docs.join(ids, "key", "left_semi"), docs.join(ids, "key", "left_anti")


@query("d07_fixed_vocabulary", f"""with {_FIT} select c.key, f.term_id, c.term, c.tf from counts c
join fitted f on f.term = c.term anti join labels l on l.doc_id = c.key""")
def d07(spark, sf):
    _, train, rest = _labelled(spark, sf)
    tokens = T.code_tokens(F.col("code"))
    vocab = X.top_vocabulary(X.term_counts(train, tokens)).select("term", "term_id")
    return X.use_vocabulary(X.term_counts(rest, tokens), vocab, X.MAX_FEATURES).select("key", "term_id", "term", "tf")


@query("d17_saved_vocabulary", f"""with {_FIT} select c.key, f.term_id, c.term, c.tf from counts c
join fitted f on f.term = c.term anti join labels l on l.doc_id = c.key""")
def d17(spark, sf):
    _, train, rest = _labelled(spark, sf)
    tokens = T.code_tokens(F.col("code"))
    saved = session.materialise(X.top_vocabulary(X.term_counts(train, tokens)).select("term", "term_id"), "vocabulary")
    return X.use_vocabulary(X.term_counts(rest, tokens), saved, X.MAX_FEATURES).select("key", "term_id", "term", "tf")


_FOLDED = f"""folded as (select doc_id as key, regexp_replace(lower(text), '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}]{{2,}}', ' ', 'g') as t
  from documents),
chars as (select key, generate_subscripts(string_split(t, ''), 1) as pos, unnest(string_split(t, '')) as c from folded),
runs as (select key, pos, c as c1, lead(c, 1) over w as c2, lead(c, 2) over w as c3, lead(c, 3) over w as c4,
                lead(c, 4) over w as c5, lead(c, 5) over w as c6 from chars window w as (partition by key order by pos))"""


def _char_sql(low: int, high: int, name: str) -> str:
    parts = [
        f"select key, {' || '.join(f'c{i}' for i in range(1, n + 1))} as term from runs where c{n} is not null"
        for n in range(low, high + 1)
    ]
    return f"{name} as (select key, term, count(*) as tf from ({' union all '.join(parts)}) group by key, term)"


_CHAR_VOCAB = _FOLDED + ", " + _char_sql(3, 6, "char_counts") + """,
char_vocab as (select term, count(*) as df from char_counts group by term having count(*) >= 10)"""
_SUB = _CHAR_VOCAB + """,
sub as (select distinct regexp_replace(term, '^\\s+|\\s+$', '', 'g') as term from char_vocab
        where length(regexp_replace(term, '^\\s+|\\s+$', '', 'g')) > 1
          and not regexp_matches(regexp_replace(term, '^\\s+|\\s+$', '', 'g'), '\\s'))"""


@query("d08_char_ngrams", f"with {_CHAR_VOCAB} select term, df from char_vocab")
def d08(spark, sf):
    return X.char_vocabulary(I.documents(spark, sf))


_SUBWORDS = _SUB + ", " + _char_sql(2, 6, "short_counts") + ", " + TOP + """,
words as (select term from top where term not in (select term from sub)),
blocks as (select c.key, 'word' as block, c.term, c.tf from counts c join words w on w.term = c.term
           union all
           select c.key, 'char' as block, c.term, c.tf from short_counts c join sub s on s.term = c.term)"""


@query("d09_subword_features", f"""with {_SUBWORDS}
select key, block, count(*) as n_terms, cast(sum(tf) as bigint) as total, min(term) as first_term, max(term) as last_term
from blocks group by key, block""")
def d09(spark, sf):
    rows = X.subword_features(I.documents(spark, sf))
    return rows.groupBy("key", "block").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.sum("tf").alias("total"),
        F.min("term").alias("first_term"),
        F.max("term").alias("last_term"),
    )


@query("d10_feature_blocks", f"""with {_grams(1)}, {TOP},
kept as (select term, count(distinct key) as df from grams group by term having count(distinct key) >= 2),
chunk_ids as (select term, row_number() over (order by term) - 1 + (select count(*) from top) as id from kept),
blocks as (select c.key, cast(t.term_id as bigint) as feature_id, cast(c.tf as double) as value
           from counts c join top t on t.term = c.term
           union all
           select g.key, i.id, cast(count(*) as double) from grams g join chunk_ids i on i.term = g.term group by g.key, i.id)
select key, feature_id, value from blocks""")
def d10(spark, sf):
    docs = I.documents(spark, sf)
    words = X.term_counts(docs, T.code_tokens(F.col("code")))
    chunks = X.term_counts(docs, T.chunk_tokens(F.col("code")))
    value = F.col("tf").cast("double").alias("value")
    return X.concat_blocks(
        [
            (words.select("key", "term", value), X.top_vocabulary(words)),
            (chunks.select("key", "term", value), X.df_vocabulary(chunks, min_count=2)),
        ]
    )


@query("d11_non_empty_rows", f"""with {_grams(1)},
fit as (select distinct term from grams where key in (select doc_id from labels))
select d.doc_id as key from documents d where d.doc_id not in (select doc_id from labels)
  and d.doc_id in (select g.key from grams g join fit f on f.term = g.term)""")
def d11(spark, sf):
    _, train, rest = _labelled(spark, sf)
    tokens = T.chunk_tokens(F.col("code"))
    vocab = X.df_vocabulary(X.term_counts(train, tokens)).select("term")
    features = X.use_vocabulary(X.term_counts(rest, tokens), vocab)
    return X.non_empty_rows(rest, features).select("key")


@query("d12_word2vec")
def d12(spark, sf):
    model = E.train_word_vectors(I.documents(spark, sf), T.code_tokens(F.col("code")))
    return E.vector_table(model).select("term", F.size("vector").alias("n_dims"))


# Given vectors: the n-th term of the vocabulary carries the embedding whose id is n.
_VECTORS = """vectors as (select t.term, e.embedding as vector from top t join embeddings e on e.vec_id = t.term_id)"""


def _vectors(spark, sf, vocab):
    given = I.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("term_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return vocab.join(given, "term_id").select("term", "vector")


@query("d13_mean_pooling", f"""with {TOP}, {_VECTORS},
dims as (select key, d as dim, sum(tf * cast(vector[d + 1] as double)) / sum(tf) as v
         from (select c.key, c.tf, v.vector, unnest(range(64)) as d from counts c join vectors v on v.term = c.term)
         group by key, d)
select d.doc_id as key, cast(r.dim as int) as dim, round(coalesce(x.v, 0e0), 6) as value
from documents d cross join (select unnest(range(64)) as dim) r left join dims x on x.key = d.doc_id and x.dim = r.dim""")
def d13(spark, sf):
    docs = I.documents(spark, sf)
    counts = X.term_counts(docs, T.code_tokens(F.col("code")))
    vectors = _vectors(spark, sf, X.top_vocabulary(counts).select("term", "term_id"))
    pooled = E.mean_pool(docs, counts, vectors, 64)
    return pooled.select("key", F.posexplode("vector").alias("dim", "value")).select(
        "key", "dim", F.round("value", 6).alias("value")
    )


@query("d14_parse_vector", """select vec_id as key, cast(d as int) as dim, round(cast(embedding[d + 1] as double), 6) as value
from (select vec_id, embedding, unnest(range(len(embedding))) as d from embeddings)""")
def d14(spark, sf):
    doubles = F.transform(F.col("embedding").cast("array<double>"), lambda x: x.cast("string"))
    printed = F.concat(F.lit("["), F.array_join(doubles, ", "), F.lit("]"))
    df = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), printed.alias("printed"))
    return exploded(df, ["key"], parse_vector(F.col("printed")), "value", "dim").select(
        "key", "dim", F.round("value", 6).alias("value")
    )


def _changes(spark, sf):
    marked = F.replace("func_before", F.lit(".\n"), F.lit(".##<END>##\n"))
    empty_side = F.when(F.col("func") == F.col("func_before"), F.lit("")).otherwise(F.col("func"))
    return I.versions(spark, sf).select("key", marked.alias("prev_data"), empty_side.alias("cur_data"))


_SIDES = I.LINES + f""",
cur as (select key, string_agg(case when {I.CHANGED} then line || ' NEW' else line end, chr(10) order by line_no) as code,
               bool_or({I.CHANGED}) as differs from x0 group by key),
sides as (select doc_id as key, 'prev' as side, replace(text, '.' || chr(10), '.') as code from documents
          union all select key, 'cur', case when differs then code else '' end from cur),
side_tokens as (select key, side, unnest(regexp_extract_all(code, '{_CODE}')) as term from sides),
side_counts as (select key, side, term, count(*) as tf from side_tokens group by key, side, term), {TOP}, {_VECTORS}"""


@query("d15_change_features", f"""with {_SIDES},
dims as (select key, side, d as dim, sum(tf * cast(vector[d + 1] as double)) / sum(tf) as v
         from (select c.key, c.side, c.tf, v.vector, unnest(range(64)) as d from side_counts c join vectors v on v.term = c.term)
         group by key, side, d)
select s.key, cast(r.dim + case when s.side = 'cur' then 64 else 0 end as bigint) as feature_id,
       round(coalesce(x.v, 0e0), 6) as value
from sides s cross join (select unnest(range(64)) as dim) r
left join dims x on x.key = s.key and x.side = s.side and x.dim = r.dim
union all
select c.key, cast(t.term_id + 128 + case when c.side = 'cur' then {X.MAX_FEATURES} else 0 end as bigint), cast(c.tf as double)
from side_counts c join top t on t.term = c.term""")
def d15(spark, sf):
    vocab = X.top_vocabulary(_counts(spark, sf)).select("term", "term_id")
    out = E.change_features(_changes(spark, sf), _vectors(spark, sf, vocab), vocab, 64, X.MAX_FEATURES)
    return out.withColumn("value", F.round("value", 6))


@query("d16_side_counts", f"""with {_SIDES}
select c.key, c.side, c.term, cast(c.tf as double) as tf from side_counts c join top t on t.term = c.term
union all
select s.key, s.side, null, null from sides s left join (select distinct key, side from side_counts) c
  on c.key = s.key and c.side = s.side where c.key is null""")
def d16(spark, sf):
    vocab = X.top_vocabulary(_counts(spark, sf))
    return E.side_counts(_changes(spark, sf), vocab).withColumn("tf", F.col("tf").cast("double"))


@query("d18_most_common", f"""with pos as (select doc_id as key, generate_subscripts(regexp_extract_all(text, '{_CODE}'), 1) as pos,
  unnest(regexp_extract_all(text, '{_CODE}')) as term from documents),
c as (select key, term, count(*) as n, min(pos) as p from pos group by key, term)
select key, term, n from (select *, row_number() over (partition by key order by n desc, p) as rn from c) where rn = 1""")
def d18(spark, sf):
    return X.most_common(I.documents(spark, sf), T.code_tokens(F.col("code")))
