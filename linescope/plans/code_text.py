"""Section C: code text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from linescope.functions import text as T
from linescope.functions.rows import exploded
from linescope.operators import diffs, scopes, slices
from linescope.plans import inputs as I
from linescope.plans.registry import query

# Oracle form of the per-line cleaning.
_CLEAN = """case when strpos(line, '//') > 0 then substr(line, 1, strpos(line, '//') - 1)
  when strpos(line, '/*') > 0 and strpos(line, '*/') > 0
  then substr(line, 1, strpos(line, '/*') - 1) || substr(line, strpos(line, '*/') + 2)
  else line end"""
_NO_COMMENT = r"regexp_replace(regexp_replace(line, '//[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("c01_remove_comments", f"""with {I.COMMENTED}
select key, string_agg({_NO_COMMENT}, chr(10) order by line_no) as code from x2 group by key""")
def c01(spark, sf):
    lines = T.split_lines(F.col("code"), "newline")
    code = F.array_join(F.transform(lines, T.strip_comments), "\n")
    return I.commented(spark, sf).select("key", code.alias("code"))


@query("c02_line_keys", f"""with {I.COMMENTED}
select key, line_no, regexp_replace({_NO_COMMENT}, '{_SPACE}', '', 'g') as line_key from x2""")
def c02(spark, sf):
    lines = T.split_lines(F.col("code"), "newline")
    return exploded(I.commented(spark, sf), ["key"], F.transform(lines, T.line_key), "line_key", "pos").select("key", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line_key")


_ALIGN = f"""with {I.LINES},
versions as (
  select key, line_no, line, ({I.CHANGED}) as changed from x0),
keyed as (
  select key, 'delete' as side, line_no, regexp_replace({_NO_COMMENT}, '{_SPACE}', '', 'g') as k from versions
  union all
  select key, 'add', line_no, regexp_replace(regexp_replace(regexp_replace(
      case when changed then line || ' NEW' else line end, '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '{_SPACE}', '', 'g')
  from versions),
places as (select key, side, k, list(line_no order by line_no) as spots from keyed group by key, side, k),
wanted as (
  select key, side, k, row_number() over (partition by key, side order by line_no) as seq
  from (select key, 'delete' as side, line_no, regexp_replace({_NO_COMMENT}, '{_SPACE}', '', 'g') as k from versions where changed
        union all
        select key, 'add', line_no, regexp_replace(regexp_replace(regexp_replace(
          line || ' NEW /* new */', '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '{_SPACE}', '', 'g') from versions where changed)),
steps as (select w.key, w.side, list(coalesce(p.spots, []) order by w.seq) as all_spots
          from wanted w left join places p on p.key = w.key and p.side = w.side and p.k = w.k group by w.key, w.side),
joined as (select key, side, array_to_string(list_reduce(all_spots, lambda hits, spots:
    case when len(list_filter(spots, lambda p: p > coalesce(hits[-1], 0))) > 0
         then list_append(hits, list_min(list_filter(spots, lambda p: p > coalesce(hits[-1], 0)))) else hits end,
    cast([] as bigint[])), ' ') as found from steps)
select d.doc_id as key, coalesce(a.found, '') as add_lines, coalesce(r.found, '') as delete_lines
from documents d left join joined a on a.key = d.doc_id and a.side = 'add'
left join joined r on r.key = d.doc_id and r.side = 'delete'"""


@query("c03_diff_alignment", _ALIGN)
def c03(spark, sf):
    return diffs.annotate_changed_lines(I.versions(spark, sf)).select("key", "add_lines", "delete_lines")


@query("c04_hunk_headers", f"""with {I.LINES},
c as (select *, count(*) filter ({I.CHANGED}) over (partition by key order by line_no rows between unbounded preceding and 1 preceding) as before
  from x0)
select key, cast((line_no - 1) / {I.HUNK_LINES} + line_no + 2 * before as int) as diff_line_no, cast(line_no as int) as start_before,
  cast(line_no + before as int) as start_after
from c where (line_no - 1) % {I.HUNK_LINES} = 0""")
def c04(spark, sf):
    return diffs.hunks(I.hunked(spark, sf))


@query("c05_clean_lines", f"""with {I.COMMENTED}
select key, line_no, {_CLEAN} as line from x2""")
def c05(spark, sf):
    lines = T.split_lines(F.col("code"), "newline")
    return exploded(I.commented(spark, sf), ["key"], F.transform(lines, T.clean_line), "line", "pos").select("key", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


@query("c06_scope_whole", f"""with {I.COMMENTED}
select key, string_agg({_CLEAN}, chr(10) order by line_no) as code from x2 group by key""")
def c06(spark, sf):
    return I.commented(spark, sf).select("key", T.clean_lines(T.split_lines(F.col("code"))).alias("code"))


def _scope_sql(kept: str, order: str = "line_no") -> str:
    """Oracle of a scope whose kept lines are the rows (key, line_no[, ord]) of ``kept``."""
    return f"""with {I.VUL}, kept as ({kept}),
cut as (select k.key, string_agg(x.line, chr(10) order by {order}) as code
        from kept k join x0 x on x.key = k.key and x.line_no = k.line_no group by k.key)
select d.doc_id as key, cast(length(d.lang) as int) as severity, coalesce(c.code, '') as code
from documents d left join cut c on c.key = d.doc_id"""


_WINDOW = """select distinct v.key, unnest(generate_series(greatest(0, v.line_no - 6), least(n.n - 1, v.line_no + 6))) as idx
  from vul v join n_lines n on n.key = v.key"""


@query("c07_scope_code", _scope_sql("select key, line_no from vul", "x.line_no"))
def c07(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "code")


@query("c08_scope_context_only", _scope_sql("""select x.key, x.line_no from x0 x
  left join vul v on v.key = x.key and v.line_no = x.line_no where v.key is null""", "x.line_no"))
def c08(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "context_only")


@query("c09_scope_vulnerable_lines", _scope_sql("select key, line_no from vul", "x.line_no"))
def c09(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "lines_without_context")


@query("c09_scope_vulnerable_lines_first_line", _scope_sql("""select key, line_no from vul union all
  select n.key, 1 from n_lines n left join (select distinct key from vul) v on v.key = n.key where v.key is null""", "x.line_no"))
def c09_first(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "lines_without_context", default_first_line=True)


@query("c10_context_window", f"""with {I.VUL}, w as ({_WINDOW})
select d.doc_id as key, coalesce(string_agg(cast(w.idx as varchar), ' ' order by w.idx), '') as indices
from documents d left join w on w.key = d.doc_id group by d.doc_id""")
def c10(spark, sf):
    df = I.annotated(spark, sf)
    window = scopes.context_window(T.split_lines(F.col("func_before")), scopes.parse_line_numbers(F.col("vul_line")), 6)
    return df.select("key", F.array_join(F.transform(window, lambda i: i.cast("string")), " ").alias("indices"))


@query("c11_scope_surrounding", _scope_sql(f"select key, idx as line_no from ({_WINDOW}) where idx >= 1", "x.line_no"))
def c11(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "surrounding_context")


@query("c11_scope_surrounding_legacy", _scope_sql(f"""select w.key, w.idx,
  case when w.idx = 0 then n.n else w.idx end as line_no from ({_WINDOW}) w join n_lines n on n.key = w.key""", "k.idx"))
def c11_legacy(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "surrounding_context", legacy_wrap=True)


_AROUND = f"select w.key, w.idx from ({_WINDOW}) w left join vul v on v.key = w.key and v.line_no = w.idx where v.key is null"


@query("c12_scope_surrounding_only", _scope_sql(f"select key, idx as line_no from ({_AROUND}) where idx >= 1", "x.line_no"))
def c12(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "surrounding_only")


@query("c12_scope_surrounding_only_legacy", _scope_sql(f"""select a.key, a.idx,
  case when a.idx = 0 then n.n else a.idx end as line_no from ({_AROUND}) a join n_lines n on n.key = a.key""", "k.idx"))
def c12_legacy(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "surrounding_only", legacy_wrap=True)


def _random_sql(shift: int) -> str:
    return _scope_sql(f"""select c.key, c.line_no, c.h from (
    select x.key, x.line_no, md5(concat_ws(':', '42', x.key, x.line_no)) as h,
           row_number() over (partition by x.key order by md5(concat_ws(':', '42', x.key, x.line_no)), x.line_no) as rn
    from x0 x left join vul v on v.key = x.key and v.line_no - {shift} = x.line_no where v.key is null) c
  join (select key, count(*) as k from vul group by key) q on q.key = c.key where c.rn <= q.k""", "k.h")


@query("c13_scope_random_context", _random_sql(0))
def c13(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "random_context")


@query("c13_scope_random_context_legacy", _random_sql(1))
def c13_legacy(spark, sf):
    return scopes.cut_scope(I.annotated(spark, sf), "random_context", legacy_candidates=True)


@query("c14_clean_changes", """select doc_id as key,
  regexp_replace(replace(text, '.' || chr(10), '.##<END>##' || chr(10)), '##<END>##[\\r\\n]', '', 'g') as code from documents""")
def c14(spark, sf):
    df = I.documents(spark, sf).withColumn("code", F.replace("code", F.lit(".\n"), F.lit(".##<END>##\n")))
    return df.select("key", T.clean_changes(F.col("code")).alias("code"))


_BARE = f"regexp_replace(regexp_replace(line, '{slices.SHIFT}', '+=', 'g'), '{slices.COMPARISON}', ' ', 'g')"


@query("c15_program_slice", f"""with recursive {I.ASSIGNED},
b as materialized (select key, line_no, {_BARE} as line from x0),
def as materialized (select distinct key, line_no, unnest(list_concat(regexp_extract_all(line, '{slices.DEFINED}', 1),
  regexp_extract_all(line, '{slices.STEPPED}', 1))) as name from b),
used as (select distinct key, line_no, unnest(regexp_extract_all(regexp_replace(line, '{slices.PLAIN}', ' ', 'g'), '{slices.NAME}')) as name from b),
edges as materialized (select distinct u.key, u.line_no as below, d.line_no as above
  from used u asof join def d on u.key = d.key and u.name = d.name and u.line_no > d.line_no),
reached as (select key, line_no from x0 where {I.CHANGED}
  union select e.key, e.above from reached r join edges e on e.key = r.key and e.below = r.line_no),
cut as (select x.key, string_agg(x.line, chr(10) order by x.line_no) as code
  from x0 x join reached r on r.key = x.key and r.line_no = x.line_no group by x.key)
select d.doc_id as key, cast(length(d.lang) as int) as severity, coalesce(c.code, '') as code
from documents d left join cut c on c.key = d.doc_id""")
def c15(spark, sf):
    return slices.cut_slice(I.assigned(spark, sf))
