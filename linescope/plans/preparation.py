"""Section B: dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from linescope import session
from linescope.functions import text as T
from linescope.functions.rows import exploded
from linescope.operators import features as X
from linescope.operators import scopes
from linescope.operators import splits as S
from linescope.plans import inputs as I
from linescope.plans.registry import query

HASH = "md5(concat_ws(':', '42', key))"
SPLIT = f"""{I.FUNCTIONS},
ranked as (select *, row_number() over (order by {HASH}, key) - 1 as rnk, count(*) over () as n from functions),
random_split as (select key, severity, case when rnk < cast(floor(0.8e0 * n) as bigint) then 'train'
  when rnk < cast(floor(0.8e0 * n) as bigint) + cast(floor(0.1e0 * n) as bigint) then 'valid' else 'test' end as partition from ranked)"""

STRATIFIED = f"""{I.FUNCTIONS},
c0 as (select severity, count(*) as size, sum(count(*)) over () as n from functions group by severity),
c1 as (select *, cast(ceil(0.3e0 * n) as bigint) as held, size * 1e0 / n * (n - cast(ceil(0.3e0 * n) as bigint)) as exact from c0),
c2 as (select *, floor(exact) as base, row_number() over (order by exact - floor(exact) desc, severity) as rk,
         sum(floor(exact)) over () as bases from c1),
c3 as (select severity, held, size, base + case when rk <= (n - held) - bases then 1 else 0 end as n_train from c2),
c4 as (select *, size - n_train as rest, held - cast(ceil(0.5e0 * held) as bigint) as n_valid from c3),
c5 as (select *, rest * 1e0 / sum(rest) over () * n_valid as exact from c4),
c6 as (select *, floor(exact) as base, row_number() over (order by exact - floor(exact) desc, severity) as rk,
         sum(floor(exact)) over () as bases from c5),
quota as (select severity, n_train, base + case when rk <= n_valid - bases then 1 else 0 end as q_valid from c6),
strat_rank as (select *, row_number() over (partition by severity order by {HASH}, key) - 1 as rnk from functions),
strat as (select r.key, r.severity, r.func_before, case when rnk < q.n_train then 'train'
  when rnk < q.n_train + q.q_valid then 'valid' else 'test' end as partition
  from strat_rank r join quota q on q.severity = r.severity)"""


@query("b01_required_columns", f"with {I.FUNCTIONS} select key, severity, length(func_before) as n_chars from functions")
def b01(spark, sf):
    df = S.require_columns(I.functions(spark, sf), ["severity", "func_before"])
    return df.select("key", "severity", F.length("func_before").cast("bigint").alias("n_chars"))


@query("b02_random_split", f"with {SPLIT} select key, severity, partition from random_split")
def b02(spark, sf):
    return S.random_split(I.functions(spark, sf).select("key", "severity"))


@query("b02_random_split_all_documents", """with r as (select doc_id as key, lang, source,
  row_number() over (order by md5(concat_ws(':', '42', doc_id)), doc_id) - 1 as rnk, count(*) over () as n from documents)
select key, lang, source, case when rnk < cast(floor(0.8e0 * n) as bigint) then 'train'
  when rnk < cast(floor(0.8e0 * n) as bigint) + cast(floor(0.1e0 * n) as bigint) then 'valid' else 'test' end as partition from r""")
def b02_all(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang", "source")
    return S.random_split(docs)


@query("b03_stratified_split", f"with {STRATIFIED} select key, severity, partition from strat")
def b03(spark, sf):
    return S.stratified_split(I.functions(spark, sf).select("key", "severity"))


@query("b03_stratified_split_80_10_10", f"with {STRATIFIED.replace('0.3e0', '0.2e0')} select key, severity, partition from strat")
def b03_80(spark, sf):
    return S.stratified_split(I.functions(spark, sf).select("key", "severity"), held_out=0.2)


@query("b04_tag_and_union", f"with {STRATIFIED} select key, severity, partition from strat")
def b04(spark, sf):
    df = session.materialise(S.stratified_split(I.functions(spark, sf).select("key", "severity")), "split")
    parts = {p: df.where(F.col("partition") == p).drop("partition") for p in ("train", "valid", "test")}
    return S.tag_and_union(parts)


@query("b05_permutation", f"with {SPLIT} select key, severity, rnk as position from ranked")
def b05(spark, sf):
    return S.permutation(I.functions(spark, sf).select("key", "severity"))


@query("b06_class_distribution", f"""with {STRATIFIED} select partition, severity, count(*) as n,
  round(count(*) * 1e0 / sum(count(*)) over (partition by partition), 6) as share from strat group by partition, severity""")
def b06(spark, sf):
    split = S.stratified_split(I.functions(spark, sf).select("key", "severity"))
    return S.class_distribution(split).withColumn("share", F.round("share", 6))


_LABELS = """names as (select doc_id as key, lang from documents),
ids as (select lang, cast(row_number() over (order by lang) - 1 as int) as label_id from (select distinct lang from names))"""


def _langs(spark, sf):
    return I.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang")


@query("b07_label_encoding", f"with {_LABELS} select n.key, n.lang, i.label_id from names n join ids i on i.lang = n.lang")
def b07(spark, sf):
    df = _langs(spark, sf)
    return S.encode_labels(df, S.fit_labels(df, "lang"), "lang").select("key", "lang", "label_id")


@query("b08_label_decoding", f"with {_LABELS} select key, lang from names")
def b08(spark, sf):
    df = _langs(spark, sf)
    labels = S.fit_labels(df, "lang")
    coded = S.encode_labels(df, labels, "lang").drop("lang")
    # One place per row of the label table.
    hot = F.transform(F.sequence(F.lit(0), F.lit(labels.count() - 1)), lambda i: F.when(i == F.col("label_id"), 1.0).otherwise(0.0))
    return S.decode_one_hot(coded.select("key", hot.alias("one_hot")), labels, "one_hot", "lang").select("key", "lang")


@query("b09_severity_cast", """select o_orderkey as key, cast(substr(o_orderpriority, 1, 1) as int) as severity,
  case substr(o_orderpriority, 1, 1) when '1' then 3 when '2' then 2 when '3' then 1 else 0 end as mapped from orders""")
def b09(spark, sf):
    text = F.substring("o_orderpriority", 1, 1)
    levels = F.create_map(*[F.lit(x) for kv in {"1": 3, "2": 2, "3": 1}.items() for x in kv])
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        text.cast("int").alias("severity"),
        F.coalesce(F.try_element_at(levels, text), F.lit(0)).alias("mapped"),
    )


@query("b10_stringify", """select coalesce(cast(d.doc_id as varchar), 'nan') as key, coalesce(cast(l.quality as varchar), 'nan') as quality,
  coalesce(cast(l.toxic as varchar), '') as toxic from documents d left join labels l on l.doc_id = d.doc_id""")
def b10(spark, sf):
    joined = I.table(spark, sf, "documents").select("doc_id").join(I.table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        T.stringify(F.col("doc_id")).alias("key"),
        T.stringify(F.col("quality")).alias("quality"),
        T.stringify(F.col("toxic"), "").alias("toxic"),
    )


@query("b11_scope_projection", f"""with {I.VUL}, v as (select key, string_agg(cast(line_no as varchar), ' ' order by line_no) as vul_line from vul group by key)
select d.doc_id as key, cast(length(d.lang) as int) as severity, d.text as code, coalesce(v.vul_line, '') as vul_line
from documents d left join v on v.key = d.doc_id""")
def b11(spark, sf):
    df = I.annotated(spark, sf).withColumnRenamed("key", "cve_id").withColumnRenamed("vul_line", "delete_lines")
    return scopes.project_scope_input(df)


@query("b12_vocabulary_difference", """with w as (select distinct unnest(regexp_extract_all(text, '[a-zA-Z0-9]+')) as term from documents),
p as (select distinct unnest(regexp_extract_all(html, '[a-zA-Z0-9]+')) as term from pages)
select term from w where term not in (select term from p)""")
def b12(spark, sf):

    def words(name, column):
        found = F.regexp_extract_all(F.col(column), F.lit(T.CODE_WORD), F.lit(0))
        return exploded(I.table(spark, sf, name), [], F.array_distinct(found), "term").distinct()

    return X.minus_terms(words("documents", "text"), words("pages", "html"))


@query("b12_row_difference", f"""with {I.VUL} select x.key, x.line_no from x0 x
  left join vul v on v.key = x.key and v.line_no = x.line_no where v.key is null""")
def b12_rows(spark, sf):
    df = I.annotated(spark, sf)
    lines = exploded(df, ["key"], T.split_lines(F.col("func_before"), "newline"), "line", "at").select(
        "key", (F.col("at") + 1).cast("bigint").alias("line_no")
    )
    vul = exploded(df, ["key"], scopes.parse_line_numbers(F.col("vul_line")), "line_no")
    vul = vul.withColumn("line_no", F.col("line_no").cast("bigint"))
    return S.minus_rows(lines, vul, ["key", "line_no"])
