"""Section A: scans, sources and sinks (attention files are with section E)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from linescope import session
from linescope.operators import metrics as M
from linescope.operators import results as R
from linescope.operators import scopes
from linescope.plans import code_text, evaluation
from linescope.plans import inputs as I
from linescope.plans.registry import query
from linescope.sources import tables as S


@query("a01_function_table", f"with {I.FUNCTIONS} select key, severity, func_before from functions")
def a01(spark, sf):
    path = session.fresh_path(spark, "functions")
    I.functions(spark, sf).write.parquet(path)
    return S.read_functions(spark, path).select("key", "severity", "func_before")


@query("a02_multiline_csv", f"with {I.COMMENTED} select key, string_agg(line, chr(10) order by line_no) as code from x2 group by key")
def a02(spark, sf):
    path = session.fresh_path(spark, "code-csv")
    S.write_code_csv(I.commented(spark, sf), path)
    schema = StructType([StructField("key", LongType()), StructField("code", StringType())])
    return S.read_code_csv(spark, path, schema)


_SCOPED = f"""with {I.VUL}, w as ({code_text._WINDOW}),
kept as (
  select 'whole' as scope, key, line_no, cast(line_no as varchar) as o from x0
  union all select 'lines_without_context', key, line_no, null from vul
  union all select 'surrounding_context', key, idx, null from w where idx >= 1
  union all select 'context_only', x.key, x.line_no, null from x0 x left join vul v on v.key = x.key and v.line_no = x.line_no where v.key is null
  union all select 'surrounding_only', a.key, a.idx, null from ({code_text._AROUND}) a where idx >= 1),
cut as (select k.scope, k.key, string_agg(x.line, chr(10) order by x.line_no) as code
        from kept k join x0 x on x.key = k.key and x.line_no = k.line_no group by k.scope, k.key)
select s.scope, count(*) as functions, cast(sum(length(coalesce(c.code, ''))) as bigint) as chars,
  min(md5(coalesce(c.code, ''))) as first_hash, max(md5(coalesce(c.code, ''))) as last_hash
from documents d cross join (values ('whole'), ('lines_without_context'), ('surrounding_context'), ('context_only'), ('surrounding_only')) s(scope)
left join cut c on c.key = d.doc_id and c.scope = s.scope group by s.scope"""


@query("a03_scope_table", _SCOPED)
def a03(spark, sf):
    path = session.fresh_path(spark, "scopes")
    S.write_scopes(scopes.cut_all_scopes(I.annotated(spark, sf)), path)
    rows = spark.read.parquet(path).where(F.col("scope") != "random_context")
    return rows.groupBy(F.col("scope").cast("string").alias("scope")).agg(
        F.count(F.lit(1)).alias("functions"),
        F.sum(F.length("code")).alias("chars"),
        F.min(F.md5("code")).alias("first_hash"),
        F.max(F.md5("code")).alias("last_hash"),
    )


@query("a03_read_one_scope", f"with {I.LINES} select doc_id as key, cast(length(lang) as int) as severity, text as code from documents")
def a03_one(spark, sf):
    path = session.fresh_path(spark, "scopes")
    S.write_scopes(scopes.cut_all_scopes(I.annotated(spark, sf)), path)
    return S.read_scope(spark, path, "whole").select("key", "severity", "code")


@query("a04_single_line_export", f"""with {I.FUNCTIONS}
select coalesce(cast(nullif(severity, {I.UNLABELLED}) as varchar), 'nan') || '<CODESPLIT>' || trim(replace(func_before, chr(10), ' ')) as value from functions""")
def a04(spark, sf):
    path = session.fresh_path(spark, "lines")
    S.write_lines(I.functions(spark, sf).withColumn("severity", F.nullif("severity", F.lit(I.UNLABELLED))), path)
    return spark.read.text(path)


_BY_LANG = f"{evaluation.PREDICTIONS}, {evaluation._scores_sql('pred', 'lang')}"


@query("a09_result_appender", f"""with {_BY_LANG}, r as ({evaluation._REPORT.format('lang, ')})
select 'first' as parameters, r.* from r union all select 'second', r.* from r""")
def a09(spark, sf):
    path = session.fresh_path(spark, "results")
    rows = M.report(evaluation.predictions(spark, sf), by=["lang"], digits=None)
    for name in ("first", "second"):
        S.append_results(rows.select(F.lit(name).alias("parameters"), "*"), path)
    schema = StructType([StructField("parameters", StringType()), *rows.schema.fields])
    back = spark.read.schema(schema).option("header", "true").csv(path)
    return evaluation.rounded(back, "parameters", "lang")


@query("a10_multitask_files", f"""with {evaluation._LONG}
select run, "set", 'code' as feature_type, 'hc' as feature_scope, 'word' as token, cast(fold as varchar) as fold, scenario,
  round(time_pred, 6) as time_pred, round(acc, 6) as acc, round(f1, 6) as f1, round(mcc, 6) as mcc, {evaluation._NONE} from long""")
def a10(spark, sf):
    path = session.fresh_path(spark, "multitask")
    df = evaluation.wide(spark, sf)
    name = F.concat(F.lit("code_hc_word_"), F.col("fold").cast("string"), F.lit("_results"))
    other = F.lit("skipped_name")
    # A third of the runs stand in files with the columns turned round.
    df.where("run % 3 <> 0").withColumn("source", name).write.partitionBy("source").option("header", "true").csv(path)
    turned = df.select(*reversed(df.columns))
    turned.where("run % 3 = 0").withColumn("source", name).write.mode("append").partitionBy("source").option("header", "true").csv(path)
    df.withColumn("source", other).write.mode("append").partitionBy("source").option("header", "true").csv(path)
    out = S.read_multitask_files(spark, path, df.schema)
    keep = [c for c in out.columns if c not in ("time_pred", *R.METRICS)]
    return evaluation.rounded(out, *keep)


@query("a11_sequential_files", """select 'cvss2_' || (case o_custkey % 2 when 0 then 'conf' else 'avail' end) as scenario, 'code' as feature_type,
  'hc' as feature_scope, 'word' as token, cast(o_custkey % 10 as varchar) as fold, o_orderkey as run, round((o_orderkey * 13 % 101) / 101e0, 6) as mcc
from orders""")
def a11(spark, sf):
    path = session.fresh_path(spark, "sequential")
    task = F.when(F.col("o_custkey") % 2 == 0, "conf").otherwise("avail")
    df = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"),
        ((F.col("o_orderkey") * 13 % 101) / F.lit(101.0)).alias("mcc"),
        F.concat_ws("_", F.lit("code_hc_word_cvss2"), task, (F.col("o_custkey") % 10).cast("string"), F.lit("results")).alias("source"),
    )
    df.where("run % 3 <> 0").write.partitionBy("source").option("header", "true").csv(path)
    turned = df.where("run % 3 = 0").select("mcc", "run", "source")
    turned.write.mode("append").partitionBy("source").option("header", "true").csv(path)
    out = S.read_sequential_files(spark, path, df.drop("source").schema)
    return out.withColumn("mcc", F.round("mcc", 6))


@query("a12_result_file_concat", f"""with {evaluation.RESULTS} select {evaluation._KEYS}, {evaluation._ROUND} from results""")
def a12(spark, sf):
    path = session.fresh_path(spark, "result-sets")
    df = evaluation.results(spark, sf)
    for name, rows in (
        ("results_open", df.where(F.col("classifier") == "O")),
        ("results_closed", df.where(F.col("classifier") != "O").select(*reversed(df.columns))),
        ("avg_results", R.average_results(df)),
    ):
        rows.write.option("header", "true").csv(f"{path}/{name}")
    return evaluation.rounded(S.read_results(spark, path, df.schema), *R.RESULT_KEYS)


@query("a13_experiment_list", f"""with runs as (select distinct lang, source from documents)
select 'method' as granularity, r.lang as scope, 'severity' as problem, r.source as feature, g.classifier, g.parameters
from runs r cross join (values {evaluation._GRID}) g(classifier, parameters)""")
def a13(spark, sf):
    path = session.fresh_path(spark, "experiments")
    runs = I.table(spark, sf, "documents").select("lang", "source").distinct()
    runs.select(F.lit("method"), "lang", F.lit("severity"), "source").write.csv(path)
    return R.plan_experiments(S.read_experiments(spark, path))
