"""Sections F (metrics and selection) and G: result analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from linescope.operators import logs as L
from linescope.operators import metrics as M
from linescope.operators import results as R
from linescope.operators import scoring, stats
from linescope.plans import inputs as I
from linescope.plans.registry import query


def predictions(spark, sf):
    true = (F.col("quality") * 2 + F.col("toxic")).cast("int")
    docs = I.table(spark, sf, "documents").select("doc_id", "lang")
    wrong = F.pmod(true + 1, F.lit(4))
    return I.table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("key"),
        F.col("lang"),
        true.alias("y_true"),
        F.when(F.col("doc_id") % 7 == 0, wrong).otherwise(true).alias("y_pred"),
    )


PREDICTIONS = """pred as (select d.doc_id as key, d.lang, quality * 2 + toxic as y_true,
  case when d.doc_id % 7 = 0 then (quality * 2 + toxic + 1) % 4 else quality * 2 + toxic end as y_pred
  from labels l join documents d on d.doc_id = l.doc_id)"""


def _scores_sql(source: str, by: str = "") -> str:
    """Class scores by a direct route: per class, per group, from the rows themselves."""
    g = f"{by}, " if by else ""
    on = f"x.{by} = c.{by} and " if by else ""
    group = f"group by {by}" if by else ""
    return f"""classes as (select distinct {g}y_true as class from {source} union select distinct {g}y_pred from {source}),
per as (select {', '.join(filter(None, ['c.' + by if by else '', 'c.class']))},
    cast(count(*) filter (where x.y_true = c.class and x.y_pred = c.class) as double) as tp,
    cast(count(*) filter (where x.y_true = c.class) as double) as t,
    cast(count(*) filter (where x.y_pred = c.class) as double) as p
  from classes c join {source} x on {on}true group by all),
rates as (select *, case when p = 0 then 0e0 else tp / p end as pr, case when t = 0 then 0e0 else tp / t end as rc,
    case when p + t = 0 then 0e0 else 2e0 * tp / (p + t) end as f from per),
scored as (select {g}sum(tp) / sum(t) as acc, avg(pr) as mpr, avg(rc) as mrc, avg(f) as mf,
    sum(pr * t) / sum(t) as wpr, sum(rc * t) / sum(t) as wrc, sum(f * t) / sum(t) as wf,
    coalesce(max(case when class = 1 then pr end), 0e0) as bpr, coalesce(max(case when class = 1 then rc end), 0e0) as brc,
    coalesce(max(case when class = 1 then f end), 0e0) as bf, count(*) filter (where t > 0) as true_classes,
    case when (sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t)) = 0 then 0e0
      else (sum(tp) * sum(t) - sum(p * t)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) end as mcc
  from rates {group})"""


def rounded(df, *keep, digits=6):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


_REPORT = """ select {0}round(acc, 6) as acc, round(case when true_classes = 1 then acc else mpr end, 6) as prec,
  round(case when true_classes = 1 then acc else mrc end, 6) as rec,
  round(case when true_classes = 1 then acc else sqrt(mpr * mrc) end, 6) as gmean,
  round(case when true_classes = 1 then acc else mf end, 6) as f1, round(mcc, 6) as mcc from scored"""


@query("f09_macro_metrics", f"with {PREDICTIONS}, {_scores_sql('pred')} {_REPORT.format('')}")
def f09(spark, sf):
    return rounded(M.report(predictions(spark, sf), digits=None))


@query("f09_macro_metrics_by_group", f"with {PREDICTIONS}, {_scores_sql('pred', 'lang')} {_REPORT.format('lang, ')}")
def f09_by(spark, sf):
    return rounded(M.report(predictions(spark, sf), by=["lang"], digits=None), "lang")


@query("f10_validation_metrics", f"""with {PREDICTIONS}, {_scores_sql('pred')}
select round(acc, 6) as acc, round(mpr, 6) as precision, round(mrc, 6) as recall, round(mf, 6) as f1, round(mcc, 6) as mcc from scored""")
def f10(spark, sf):
    return rounded(M.validation_report(predictions(spark, sf)))


_AVERAGED = """ select round(acc, 6) as acc, round({0}pr, 6) as precision, round({0}rc, 6) as recall, round(acc, 6) as f1_micro,
  round(mf, 6) as f1_macro, round({0}f, 6) as f1, round(sqrt({0}pr * {0}rc), 6) as gmean, round(mcc, 6) as mcc from scored"""


@query("f11_weighted_metrics", f"with {PREDICTIONS}, {_scores_sql('pred')} {_AVERAGED.format('w')}")
def f11(spark, sf):
    return rounded(M.averaged_report(predictions(spark, sf), binary=False))


_BINARY = PREDICTIONS + ", two as (select lang, cast(y_true >= 2 as int) as y_true, cast(y_pred >= 2 as int) as y_pred from pred)"


@query("f11_binary_metrics", f"with {_BINARY}, {_scores_sql('two')} {_AVERAGED.format('b')}")
def f11_binary(spark, sf):
    two = predictions(spark, sf).select(
        (F.col("y_true") >= 2).cast("int").alias("y_true"), (F.col("y_pred") >= 2).cast("int").alias("y_pred")
    )
    return rounded(M.averaged_report(two, binary=True))


@query("f12_logits", f"""with logits as (select vec_id, label as y_true, embedding as l from embeddings),
pred as (select y_true, cast(list_position(l, list_max(l)) - 1 as int) as y_pred from logits), {_scores_sql('pred')}
select round(mf, 6) as macro_f1, round(mcc, 6) as mcc from scored""")
def f12(spark, sf):
    df = I.table(spark, sf, "embeddings").select("label", F.col("embedding").alias("logits"))
    return rounded(M.logits_report(df, "logits", "label"))


RESULTS = """results as (select l_returnflag as problem, 'method' as granularity, 'whole' as scope, 'bow' as feature,
  l_linestatus as classifier, cast(l_linenumber as varchar) as parameters, case when l_linenumber = 7 then null else l_discount - 0.02e0 end as val_mcc, l_tax as val_f1,
  l_quantity as train_time from lineitem)"""


def results(spark, sf):
    return I.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("problem"),
        F.lit("method").alias("granularity"),
        F.lit("whole").alias("scope"),
        F.lit("bow").alias("feature"),
        F.col("l_linestatus").alias("classifier"),
        F.col("l_linenumber").cast("string").alias("parameters"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount") - F.lit(0.02)).alias("val_mcc"),
        F.col("l_tax").alias("val_f1"),
        F.col("l_quantity").alias("train_time"),
    )


_KEYS = "problem, granularity, scope, feature, classifier, parameters"
_AVG = RESULTS + f""", averaged as (select {_KEYS}, avg(val_mcc) as val_mcc, avg(val_f1) as val_f1, avg(train_time) as train_time
  from results group by {_KEYS})"""
_ROUND = "round(val_mcc, 6) as val_mcc, round(val_f1, 6) as val_f1, round(train_time, 6) as train_time"


@query("f13_average_results", f"with {_AVG} select {_KEYS}, {_ROUND} from averaged")
def f13(spark, sf):
    return rounded(R.average_results(results(spark, sf)), *R.RESULT_KEYS)


@query("f14_best_results", f"""with {_AVG}, ranked as (select *, row_number() over (partition by problem, granularity, scope
  order by val_mcc desc, feature, classifier, parameters) as rn from averaged where val_mcc is not null)
select {_KEYS}, {_ROUND} from ranked where rn = 1""")
def f14(spark, sf):
    return rounded(R.best_results(R.average_results(results(spark, sf))), *R.RESULT_KEYS)


@query("f15_best_parameters", f"""with {RESULTS}, m as (select classifier, parameters, avg(val_mcc) as a from results group by classifier, parameters
  having avg(val_mcc) > 0), w as (select *, row_number() over (partition by classifier order by a desc, parameters) as rn from m)
select r.problem, r.granularity, r.scope, r.feature, r.classifier, r.parameters, {_ROUND}
from results r join w on w.classifier = r.classifier and w.parameters = r.parameters where w.rn = 1""")
def f15(spark, sf):
    return rounded(R.best_parameters(results(spark, sf)), *R.RESULT_KEYS)


_GRID = ", ".join(f"('{m}', '{p}')" for m, p in R.grid())


@query("f07_grid", f"""with runs as (select distinct lang, source from documents)
select 'severity' as problem, 'method' as granularity, r.lang as scope, r.source as feature, g.classifier, g.parameters
from runs r cross join (values {_GRID}) g(classifier, parameters)""")
def f07(spark, sf):
    runs = I.table(spark, sf, "documents").select("lang", "source").distinct()
    base = runs.select(
        F.lit("severity").alias("problem"), F.lit("method").alias("granularity"), F.col("lang").alias("scope"), F.col("source").alias("feature")
    )
    return R.plan_experiments(base)


# --- section G ---------------------------------------------------------------------------

WIDE = """wide as (select o_orderkey as run, 'folds' as "set", o_custkey % 10 as fold, (o_orderkey * 13 % 101) / 101e0 as accuracy,
  (o_orderkey * 29 % 101) / 101e0 as mcc, o_totalprice as pred_time, (o_orderkey * 17 % 101) / 101e0 as cvss2_conf_mcc,
  (o_orderkey * 19 % 101) / 101e0 as cvss2_avail_mcc, (o_orderkey * 23 % 101) / 101e0 as cvss2_conf_f1 from orders)"""


def wide(spark, sf):
    key = F.col("o_orderkey")

    def share(k):
        return (key * k % 101) / F.lit(101.0)

    return I.table(spark, sf, "orders").select(
        key.alias("run"),
        F.lit("folds").alias("set"),
        (F.col("o_custkey") % 10).alias("fold"),
        share(13).alias("accuracy"),
        share(29).alias("mcc"),
        F.col("o_totalprice").alias("pred_time"),
        share(17).alias("cvss2_conf_mcc"),
        share(19).alias("cvss2_avail_mcc"),
        share(23).alias("cvss2_conf_f1"),
    )


_LONG = WIDE + """, long as (
  select run, "set", fold, pred_time as time_pred, 'multitask' as scenario, accuracy as acc, null::double as f1, mcc from wide union all
  select run, "set", fold, pred_time, 'cvss2_conf', null, cvss2_conf_f1, cvss2_conf_mcc from wide union all
  select run, "set", fold, pred_time, 'cvss2_avail', null, null, cvss2_avail_mcc from wide)"""
_NONE = "null::double as rec, null::double as prec, null::double as gmean, null::double as auc"


@query("g01_multitask_to_long", f"""with {_LONG} select run, "set", fold, scenario, round(time_pred, 6) as time_pred,
  round(acc, 6) as acc, round(f1, 6) as f1, round(mcc, 6) as mcc, {_NONE} from long""")
def g01(spark, sf):
    return rounded(R.multitask_to_long(wide(spark, sf), avg=False), "run", "set", "fold", "scenario")


@query("g01_multitask_to_long_averaged", f"""with {_LONG} select scenario, round(avg(time_pred), 4) as time_pred,
  round(avg(acc), 6) as acc, round(avg(f1), 6) as f1, round(avg(mcc), 6) as mcc, {_NONE} from long group by scenario""")
def g01_avg(spark, sf):
    out = R.multitask_to_long(wide(spark, sf), avg=True)
    return rounded(rounded(out, "scenario", "time_pred"), *[c for c in out.columns if c != "time_pred"], digits=4)


@query("g02_table_mean", f"""with {RESULTS} select {_ROUND.replace('round(', 'round(avg(').replace(', 6)', '), 6)')} from results""")
def g02(spark, sf):
    return rounded(R.summarise(results(spark, sf), "mean"))


@query("g02_table_sum", f"""with {RESULTS} select {_ROUND.replace('round(', 'round(sum(').replace(', 6)', '), 4)')} from results""")
def g02_sum(spark, sf):
    return rounded(R.summarise(results(spark, sf), "sum"), digits=4)


def training_logs(spark, sf):
    """(log_id, value): one log per 100 events, one run per event."""
    e = I.table(spark, sf, "events").select("event_id", "user_id")
    event, epochs = F.col("event_id"), (F.col("user_id") % 4 + 2).cast("int")

    def epoch(i):
        return F.concat(
            F.lit("Epoch "), i.cast("string"), F.lit("/"), epochs.cast("string"), F.lit("\n10/10 - "),
            (F.lit(5) + (event * 3 + i) % 20).cast("string"), F.lit("s - loss: 0.5\nValidation time: "),
            (F.lit(1) + (event + i) % 4).cast("string"), F.lit(".25\n"),
            F.when(i <= event % 4, F.lit("Saving best model at epoch\n")).otherwise(""),
        )

    place = event % 100
    text = F.concat(
        F.when(place % 10 == 0, F.concat(F.lit("Current partition: "), F.floor(place / 10).cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("Run # "), (place % 10).cast("string"), F.lit("\n"),
        F.array_join(F.transform(F.sequence(F.lit(1), epochs), epoch), ""),
        F.lit("Evaluating the best model\nEvaluating the best model\nValidation time: "), (event % 7).cast("string"), F.lit(".5\n"),
    )
    rows = e.select(F.floor(event / 100).alias("log_id"), F.struct(place.alias("place"), text.alias("text")).alias("run"))
    # At most 100 runs form a log.
    return rows.groupBy("log_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda r: r["text"]), "").alias("value")
    )


_EPOCHS = """ep as (select event_id, event_id // 100 as log_id, cast(event_id % 100 // 10 as int) as partition, cast(event_id % 10 as int) as run,
  unnest(range(1, user_id % 4 + 3)) as epoch from events),
epochs as (select *, 5 + (event_id * 3 + epoch) % 20 as seconds, 1 + (event_id + epoch) % 4 + 0.25e0 as val_seconds,
  epoch <= event_id % 4 as best from ep)"""


@query("g03_log_epochs", f"""with {_EPOCHS} select log_id, partition, run, cast(epoch as int) as epoch, cast(seconds as int) as seconds,
  val_seconds, best from epochs""")
def g03(spark, sf):
    return L.log_epochs(training_logs(spark, sf))


@query("g03_log_violations", """select cast(0 as bigint) as log_id, cast(0 as int) as partition, cast(0 as int) as run, '' as violation where false""")
def g03_violations(spark, sf):
    return L.log_violations(training_logs(spark, sf))


@query("g04_run_timing", f"""with {_EPOCHS},
b as (select *, max(case when best then epoch end) over (partition by event_id) as best_epoch from epochs)
select log_id, partition, run, round(avg(seconds), 6) as avg_time_per_epoch, cast(max(best_epoch) as double) as number_of_epoch_at_best_model,
  cast(count(*) as int) as number_of_epoch_at_finish,
  cast(sum(case when epoch <= best_epoch then seconds end) as double) as total_train_time_at_best_model,
  cast(sum(seconds) as double) as total_train_time_at_finish,
  sum(case when epoch <= best_epoch then val_seconds end) as total_val_time_at_best_model,
  sum(val_seconds) as total_val_time_at_finish,
  sum(case when epoch <= best_epoch then val_seconds + seconds end) as total_time_at_best_model,
  sum(val_seconds + seconds) as total_time_at_finish, max(event_id % 7) + 0.5e0 as final_evaluation_time
from b group by event_id, log_id, partition, run""")
def g04(spark, sf):
    rows = L.run_timing(training_logs(spark, sf)).withColumn(
        "number_of_epoch_at_best_model", F.col("number_of_epoch_at_best_model").cast("double")
    )
    return rows.withColumn("avg_time_per_epoch", F.round("avg_time_per_epoch", 6))


_TASKS = ", ".join(f"'{t}'" for t in stats.TASKS)
SIDES = f"""sides as (select [{_TASKS}][l_linenumber] as scenario, case l_returnflag when 'A' then 'A' else 'B' end as side,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as key, l_discount * 10e0 - l_tax as value from lineitem where l_quantity <> 9)"""


def sides(spark, sf):
    task = F.get(F.array(*[F.lit(t) for t in stats.TASKS]), F.col("l_linenumber") - 1)
    return (
        I.table(spark, sf, "lineitem")
        .select(
            task.alias("scenario"),
            F.when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("side"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
            # A missing value on either side leaves the test.
            F.when(F.col("l_quantity") != 9, F.col("l_discount") * 10.0 - F.col("l_tax")).alias("value"),
        )
    )


_MW = """mw_rank as (select *, rank() over (partition by scenario order by value) + (count(*) over (partition by scenario, value) - 1) / 2e0 as r,
    count(*) over (partition by scenario, value) as t from {0}),
mw as (select scenario, cast(count(*) filter (where side = 'A') as double) as na, cast(count(*) filter (where side = 'B') as double) as nb,
    sum(case when side = 'A' then r else 0e0 end) as ra, sum(cast(t as double) * t - 1) as ties,
    avg(case when side = 'A' then value end) as ma, avg(case when side = 'B' then value end) as mb from mw_rank group by scenario),
mw2 as (select *, ra - na * (na + 1) / 2 as u, na + nb as n, case when ma < mb then 'greater' else 'less' end as alternative from mw),
mwz as (select scenario, alternative, u, ((case when alternative = 'greater' then u else na * nb - u end) - na * nb / 2 - 0.5e0)
    / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))) as z from mw2)"""


def _tail(z: str) -> str:
    """P(Z > z): the odd series of the normal density, its terms by logarithms."""
    far = f"greatest(abs({z}), 1e-300)"
    terms = f"[exp((2 * k + 1) * ln({far}) - lgamma(2e0 * k + 2) + k * ln(2e0) + lgamma(k + 1e0)) for k in range(120)]"
    upper = f"(0.5e0 - exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum({terms}))"
    return f"(case when {z} < 0 then 1 - {upper} else {upper} end)"


@query("g05_mann_whitney", f"""with {SIDES}, {_MW.format('sides')}
select scenario, alternative, u, round(z, 6) as z, round({_tail('z')}, 9) as p from mwz""")
def g05(spark, sf):
    tested = stats.mann_whitney(sides(spark, sf))
    return tested.select("scenario", "alternative", "u", F.round("z", 6).alias("z"), F.round("p", 9).alias("p"))


_WILCOXON = """pos as (select *, row_number() over (partition by scenario, side order by key) as plain,
    row_number() over (partition by scenario, side order by md5(concat_ws(':', '42', key)), key) as sampled from {0}),
n as (select scenario, count(*) filter (where side = 'A') as na, count(*) filter (where side = 'B') as nb from {0} group by scenario),
pa as (select p.scenario, p.value, case when n.na > n.nb then p.sampled else p.plain end as i from pos p join n on n.scenario = p.scenario where side = 'A'),
pb as (select p.scenario, p.value, case when n.nb > n.na then p.sampled else p.plain end as i from pos p join n on n.scenario = p.scenario where side = 'B'),
d as (select pa.scenario, pa.value - pb.value as d from pa join pb on pa.scenario = pb.scenario and pa.i = pb.i where pa.value <> pb.value),
dr as (select *, rank() over (partition by scenario order by abs(d)) + (count(*) over (partition by scenario, abs(d)) - 1) / 2e0 as r,
    count(*) over (partition by scenario, abs(d)) as t from d),
ws as (select scenario, count(*) as n, sum(case when d > 0 then r else 0e0 end) as up, sum(case when d < 0 then r else 0e0 end) as down,
    sum(cast(t as double) * t - 1) as ties from dr group by scenario),
wz as (select scenario, n, least(up, down) as w, (least(up, down) - n * (n + 1e0) / 4)
    / sqrt((n * (n + 1e0) * (2e0 * n + 1) - 0.5e0 * ties) / 24) as z from ws)"""


@query("g06_wilcoxon", f"""with {SIDES}, {_WILCOXON.format('sides')}
select scenario, n, w, round(z, 6) as z, round(2 * {_tail('abs(z)')}, 9) as p from wz""")
def g06(spark, sf):
    return stats.wilcoxon(sides(spark, sf)).select("scenario", "n", "w", F.round("z", 6).alias("z"), F.round("p", 9).alias("p"))


_COHEN = """moments as (select scenario, count(case when side = 'A' then value end) as na, count(case when side = 'B' then value end) as nb,
    avg(case when side = 'A' then value end) as ma, avg(case when side = 'B' then value end) as mb,
    var_samp(case when side = 'A' then value end) as va, var_samp(case when side = 'B' then value end) as vb from {0} group by scenario),
cohen as (select scenario, na, nb, ma, mb, abs(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) as cohen_d from moments)"""


@query("g07_cohen_d", f"with {SIDES}, {_COHEN.format('sides')} select scenario, round(cohen_d, 6) as cohen_d from cohen")
def g07(spark, sf):
    return rounded(stats.cohen_d(sides(spark, sf)), "scenario")


_EVERY = "every as (select * from sides union all select 'overall', side, key, value from sides)"


_COMPARED = f"""with {SIDES}, {_EVERY},
{_MW.format('every')}, {_COHEN.format('every')}, {_WILCOXON.format('every')}
select c.scenario, 'old' as "A", 'new' as "B", c.na as n_a, c.nb as n_b, round(c.ma, 6) as mean_a, round(c.mb, 6) as mean_b,
  round(c.cohen_d, 6) as cohen_d, round({_tail('mwz.z')}, 6) as mwyu, round(2 * {_tail('abs(wz.z)')}, 6) as wilcoxon
from cohen c join mwz on mwz.scenario = c.scenario join wz on wz.scenario = c.scenario"""


@query("g08_compare", _COMPARED)
def g08(spark, sf):
    return rounded(stats.compare(sides(spark, sf), "old", "new"), "scenario", "A", "B", "n_a", "n_b")


@query("g08_compare_p_values", f"select scenario, mwyu, wilcoxon from ({_COMPARED})")
def g08_p(spark, sf):
    return rounded(stats.compare(sides(spark, sf), "old", "new").select("scenario", "mwyu", "wilcoxon"), "scenario")


_METRICS = {"mcc": "l_discount * 10e0 - l_tax", "f1": "l_tax * 5e0 + l_discount"}


def _g08_metrics_sql() -> str:
    # Every metric of a task is a group of its own; the groups are then laid side by side.
    rows = " union all ".join(
        f"select '{m}:' || s.scenario as scenario, side, key, {value} as value from wide s" for m, value in _METRICS.items()
    )
    cols = []
    for m in _METRICS:
        for out, c in {
            "mean_A": "c.ma", "mean_B": "c.mb", "cohend": "c.cohen_d", "mwyu": _tail("mwz.z"), "wilcoxon": f"2 * {_tail('abs(wz.z)')}",
        }.items():
            cols.append(f"max(case when c.scenario like '{m}:%' then round({c}, 6) end) as {out}_{m}")
        cols += [f"max(case when c.scenario like '{m}:%' then c.n{x} end) as n_{x.upper()}_{m}" for x in "ab"]
    return f"""with base as (select [{_TASKS}][l_linenumber] as scenario, case l_returnflag when 'A' then 'A' else 'B' end as side,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as key, l_discount, l_tax from lineitem),
wide as (select * from base union all select 'overall', side, key, l_discount, l_tax from base), every as ({rows}),
{_MW.format('every')}, {_COHEN.format('every')}, {_WILCOXON.format('every')}
select split_part(c.scenario, ':', 2) as scenario, 'old' as "A", 'new' as "B", {', '.join(cols)}
from cohen c join mwz on mwz.scenario = c.scenario join wz on wz.scenario = c.scenario group by 1"""


@query("g08_compare_metrics", _g08_metrics_sql())
def g08_metrics(spark, sf):
    task = F.get(F.array(*[F.lit(t) for t in stats.TASKS]), F.col("l_linenumber") - 1)
    rows = I.table(spark, sf, "lineitem").select(
        task.alias("scenario"),
        F.when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("side"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        (F.col("l_discount") * 10.0 - F.col("l_tax")).alias("mcc"),
        (F.col("l_tax") * 5.0 + F.col("l_discount")).alias("f1"),
    )
    counts = [f"n_{x}_{m}" for m in _METRICS for x in "AB"]
    return rounded(stats.compare_metrics(rows, tuple(_METRICS), "old", "new"), "scenario", "A", "B", *counts)


# Seven tasks; the last value of each list is the unknown mark.
_PRED_MULT = {t: 2 * i + 3 for i, t in enumerate(scoring.SCORED_TASKS)}


def _scale(task):
    return scoring.SCALES.get(task, ["NETWORK", "LOCAL", "ADJACENT"])


def severity_predictions(spark, sf):
    cols = [F.col("event_id").alias("commit")]
    for task, m in _PRED_MULT.items():
        values = F.array(*[F.lit(v) for v in [*_scale(task), "-"]])
        cols.append(F.get(values, (F.col("event_id") % 3).cast("int")).alias(task))
        cols.append(F.get(values, ((F.col("event_id") * m + F.col("user_id")) % 4).cast("int")).alias(f"{task}-pred"))
    return I.table(spark, sf, "events").select(*cols)


def _g09_sql() -> str:
    cols, absolute, partial = [], [], []
    for i, (task, m) in enumerate(_PRED_MULT.items()):
        cols.append(f"event_id % 3 as t{i}, (event_id * {m} + user_id) % 4 as p{i}")
        absolute.append(f"case when t{i} <> p{i} then 1 else 0 end")
        step = f"abs(t{i} - p{i}) / 2e0" if task in scoring.SCALES else "1e0"
        unknown = f"when p{i} = 3 then 0e0" if task in scoring.SCALES else ""
        partial.append(f"case when t{i} = p{i} then 0e0 {unknown} else {step} end")
    return f"""with v as (select event_id, {', '.join(cols)} from events)
select event_id as commit, cast({' + '.join(absolute)} as int) as score_abs, {' + '.join(partial)} as score_partial from v"""


@query("g09_prediction_distance", _g09_sql())
def g09(spark, sf):
    return scoring.prediction_distance(severity_predictions(spark, sf)).select("commit", "score_abs", "score_partial")
