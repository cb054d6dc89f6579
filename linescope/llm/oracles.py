"""SQL of the queries that SQL can express."""

from __future__ import annotations

from linescope.llm import lines, quality_rules, url_filter

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = "[\\x20\\x09-\\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_BREAK}'), lambda x: x <> '')"


NEAR_DEDUP = f"""with recursive w as (
  select doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then []
    when len(ws) = 1 then [ws[1]]
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select p.a, p.b from pairs p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.i >= 80 * (x.n + y.n - p.i)),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from reach r join edges e on e.a = r.b)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.b) as component_id, min(r.b) = d.doc_id as kept
from documents d join reach r on r.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""


LINE_DEDUP = f"""with l as (select doc_id, source, unnest(string_split(text, chr(10))) as raw,
    generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
t as (select *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as x from l),
c as (select *, coalesce(lag(x) over w, '') as before, coalesce(lead(x) over w, '') as after from t
      window w as (partition by doc_id order by i)),
bad as (select x from c where x <> '' group by x having count(distinct source) >= {lines.MIN_SITES}
        and count(distinct (before, after)) >= greatest(count(*) * {lines.CONTEXT_SHARE}e0, 2e0)),
kept as (select t.doc_id, coalesce(string_agg(t.raw, chr(10) order by t.i) filter (where bad.x is null), '') as text,
    count(bad.x) as n_removed from t left join bad on bad.x = t.x group by t.doc_id)
select doc_id, text, n_removed, length(text) as n_chars from kept"""


def _rules() -> str:
    def fence(level: str, x: str, side: str) -> str:
        q = f"{level}.{x}"
        reach = f"greatest({q}[2] - {q}[1], {quality_rules.LEAST_SPREAD[x]}e0) * {quality_rules.SPREAD}e0"
        return f"{q}[2] + {reach}" if side == "hi" else f"{q}[1] - ({reach})"

    def bound(x: str, side: str) -> str:
        g = quality_rules.GROUP_ROWS
        return (
            f"case when o.n >= {g} then {fence('o', x, side)} when l.n >= {g} then {fence('l', x, side)} else {fence('a', x, side)} end"
        )

    quartiles = ", ".join(f"quantile_disc({x}, [0.25, 0.75]) as {x}" for x in quality_rules.LEAST_SPREAD)
    cases = []
    for x in quality_rules.LEAST_SPREAD:
        bad = f"r.{x} > {bound(x, 'hi')}"
        if x in quality_rules.TWO_SIDED:
            bad += f" or r.{x} < {bound(x, 'lo')}"
        cases.append(f"when {bad} then '{x}'")
    return f"""with w as (select doc_id, lang, source, coalesce(text, '') as t, {_words("coalesce(text, '')")} as ws from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w),
m as (select w.doc_id, lang, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(c.n, 0) as n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals, len(ls) as n_lines
  from w join lines on lines.doc_id = w.doc_id left join covered c on c.doc_id = w.doc_id),
r as (select *, n_words < {quality_rules.LEAST_WORDS} or 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words as base_failed,
    n_symbols / n_words::double as symbols, n_capitals / word_chars::double as capitals, n_repeat_words / n_words::double as repeats,
    n_dup_lines / n_lines::double as dup_lines, word_chars / n_words::double as word_length from m),
p as (select * from r where not base_failed),
o as (select lang, source, count(*) as n, {quartiles} from p group by lang, source),
l as (select lang, count(*) as n, {quartiles} from p group by lang),
a as (select count(*) as n, {quartiles} from p),
judged as (select r.*, case when base_failed then 'base' {' '.join(cases)} end as broken
  from r left join o on o.lang = r.lang and o.source = r.source left join l on l.lang = r.lang cross join a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken is null as kept, broken from judged"""


#: A sketch is exact up to ``SKETCH_K`` rows of a group; so is this comparison.
QUALITY_RULES = _rules()


LEAKS = f"""with d as (select doc_id, {_words("lower(coalesce(text, ''))")} as ws from documents),
b as (select item_id, {_words("lower(coalesce(text, ''))")} as ws from benchmark),
bs as (select item_id, len(ws) as l, i - 1 as at, array_to_string(ws[i:i + 4], ' ') as g
       from (select *, unnest(range(1, len(ws) - 3)) as i from b where len(ws) >= 5)),
ds as (select doc_id, len(ws) as n, i - 1 as pos, array_to_string(ws[i:i + 4], ' ') as g
       from (select *, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5)),
laid as (select distinct ds.doc_id, bs.item_id, bs.l, greatest(least(ds.pos - bs.at, ds.n - bs.l), 0) as start
         from ds join bs on bs.g = ds.g),
win as (select laid.*, ds.g, row_number() over (partition by laid.doc_id, laid.item_id, laid.start, ds.g) as k
        from laid join ds on ds.doc_id = laid.doc_id and ds.pos between laid.start and laid.start + laid.l - 5),
it as (select item_id, g, row_number() over (partition by item_id, g) as k from bs),
sizes as (select item_id, count(*) as n from it group by item_id),
met as (select win.doc_id, win.item_id, win.l, win.start, count(*) as n, count(it.k) as shared
        from win left join it on it.item_id = win.item_id and it.g = win.g and it.k = win.k group by all),
sim as (select met.*, shared / (met.n + sizes.n - shared)::double as similarity from met join sizes on sizes.item_id = met.item_id)
select doc_id, item_id, similarity, start, l as n_words from sim where similarity * 100 >= 80
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1"""


def url_verdicts(rules: list[tuple[str, str, str]]) -> str:
    def level(k: int) -> str:
        return f"""c{k} as (select host, prefix, segs[{k}] as seg, count(*) as n from r{k - 1} where segs[{k}] is not null group by all),
v{k} as (select host, prefix from c{k} group by all having count(*) > {url_filter.CHILDREN} and sum(n) < count(*) * {url_filter.CHILD_ROWS}),
r{k} as (select r.page_id, r.host, r.path, r.label, r.segs, case when segs[{k}] is null then r.parent else r.prefix end as parent,
  case when segs[{k}] is null then r.prefix else r.prefix || '/' || case when v.host is null then segs[{k}] else '*' end end as prefix
  from r{k - 1} r left join v{k} v on v.host = r.host and v.prefix = r.prefix)"""

    last = url_filter.LEVELS
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    w, z = url_filter.WEIGHT, url_filter.Z
    return f"""with named as (select page_id, coalesce(url, '') as u,
    try_cast(regexp_extract(url, '([0-9]+)[^0-9/?#]*/?(?:[?#].*)?$', 1) as bigint) as doc from pages),
good as (select doc_id, avg(quality) as label from labels group by doc_id),
cut as (select page_id, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{UPPER.lower()}') as host,
    regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path, label from named left join good on good.doc_id = named.doc),
parts as (select *, string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '*', 'g'), '/') as p from cut),
r0 as (select page_id, host, path, label, case when path = '' then [] when len(p) <= {last} then p
    else list_concat(p[1:{last - 1}], [array_to_string(p[{last}:], '/')]) end as segs, '' as parent, '' as prefix from parts),
{", ".join(level(k) for k in range(1, last + 1))},
leaves as (select host, parent, prefix, sum(coalesce(label, 0e0)) as k, count(label)::double as n from r{last} group by all),
hosts as (select host, sum(k) as k, sum(n) as n from leaves group by host),
whole as (select (coalesce(sum(k), 0) + 1e0) / (coalesce(sum(n), 0) + 2e0) as share from leaves),
parents as (select host, parent, sum(k) as k, sum(n) as n from leaves group by all),
placed as (select l.*, p.k as k_all, p.n as n_all, p.k - l.k as k_rest, p.n - l.n as n_rest from leaves l join parents p using (host, parent)),
tested as (select *, case when n > 0 and n_rest > 0 then coalesce(not (abs(k / n - k_rest / n_rest)
      > sqrt(k_all / n_all * (1 - k_all / n_all) * (1 / n + 1 / n_rest)) * {z}e0
      and sqrt(k_all / n_all * (1 - k_all / n_all) * (1 / n + 1 / n_rest)) > 0), true) else true end as merged from placed),
joint as (select host, parent, sum(k) as k, sum(n) as n from tested where merged group by all),
shares as (select t.host, t.parent, t.prefix, case when merged then j.k else t.k end as k, case when merged then j.n else t.n end as n,
    (t.k_all + (h.k + {w}e0 * whole.share) / (h.n + {w}e0) * {w}e0) / (t.n_all + {w}e0) as above
  from tested t join hosts h on h.host = t.host cross join whole left join joint j on j.host = t.host and j.parent = t.parent),
pure as (select host, parent, prefix, (k + above * {w}e0) / (n + {w}e0) as purity from shares),
rules as (select * from (values {values}) x(verdict, host, start)),
fit as (select r.page_id, arg_max(rules.host || start, length(rules.host || start)) as rule, arg_max(verdict, length(rules.host || start)) as verdict
  from r{last} r join rules on (r.host = rules.host or ends_with(r.host, '.' || rules.host)) and starts_with(r.path, start) group by r.page_id)
select r.page_id, r.host, r.path, fit.rule, coalesce(fit.verdict, case when purity < {url_filter.PURITY}e0 then 'block' else 'allow' end) as verdict,
  r.prefix as template, purity
from r{last} r left join pure on pure.host = r.host and pure.parent = r.parent and pure.prefix = r.prefix left join fit on fit.page_id = r.page_id"""


def crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, eight shifts a character."""
    byte = f"list_prepend(4294967295::bigint, list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::bigint))"
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    return f"xor(4294967295, list_reduce({byte}, lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: {step})))"


def periodic_runs(least: int, power: int) -> str:
    return f"""with w as (select doc_id, {crc32("doc_id::varchar")} as h, {_words("coalesce(text, '')")} as ws from documents),
c as (select doc_id, ws, len(ws) as n, h % 10 = 0 and len(ws) > 0 as edited, h // 10 as g from w),
e as (select *, case when edited then g % n else n end as a, case when edited then 1 + (n - g % n) // (3 + g % 8) else 1 end as p from c),
d as (select doc_id, n, list_transform(range(0, n), lambda i: ws[1 + case when i >= a then a + (i - a) % p else i end]) as ws from e),
pos as (select doc_id, n, i, ws[i + 1] as w from (select *, unnest(range(0, n)) as i from d)),
pairs as (select x.doc_id, x.i, y.i - x.i as q from pos x join pos y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i
  where (y.i - x.i) * {power} <= x.n),
isles as (select *, i - row_number() over (partition by doc_id, q order by i) as isle from pairs),
far as (select doc_id, min(i) as s, count(*) + q as l, q from isles group by doc_id, q, isle
  having count(*) >= greatest({least} - q, {power - 1} * q)),
runs as (select * from far f where not exists (select 1 from far o where o.doc_id = f.doc_id and o.q < f.q and o.s <= f.s and o.s + o.l >= f.s + f.l)),
best as (select * from runs qualify row_number() over (partition by doc_id order by l::double / q desc, s, q) = 1),
told as (select doc_id, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as rs from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
left_over as (select p.doc_id, string_agg(p.w, ' ' order by p.i) as t from pos p anti join gone g on g.doc_id = p.doc_id and g.i = p.i group by p.doc_id)
select d.doc_id, coalesce(told.n_runs, 0) as n_runs, best.s as start, best.l as length, best.q as period, 1000 * best.l // best.q as exponent_milli,
  sha256(coalesce(rs, '')) as runs_sha256, sha256(coalesce(left_over.t, '')) as collapsed_sha256
from d left join told on told.doc_id = d.doc_id left join best on best.doc_id = d.doc_id left join left_over on left_over.doc_id = d.doc_id"""


def divergence(min_docs: int, top_terms: int) -> str:
    low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    return f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all({low}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents),
occ as (select r, lang, source, unnest(ts) as t from d),
vocab as materialized (select lang, t from (select distinct r, lang, t from occ) group by all having count(*) >= {min_docs}),
cnt as materialized (select lang, source, t, count(*) as n from occ join vocab using (lang, t) group by all),
sizes as (select lang, count(*) as v from vocab group by lang),
totals as (select lang, source, sum(n) as total from cnt group by all),
groups as materialized (select lang, source, coalesce(total, 0)::hugeint as total, coalesce(v, 0)::hugeint as v from (select distinct lang, source from d)
  left join totals using (lang, source) left join sizes using (lang)),
dense as materialized (select g.lang, g.source, vocab.t, coalesce(n, 0) as n, (1 + (coalesce(n, 0) + 1) * 1000000000 // (total + g.v))::bigint as p
  from groups g join vocab on vocab.lang = g.lang left join cnt on cnt.lang = g.lang and cnt.source = g.source and cnt.t = vocab.t),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from dense a join dense b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a
  join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
spoken as (select lang, t, (1 + (sum(n) + 1) * 1000000000::hugeint // (any_value(g.total) + any_value(g.v)))::bigint as q from cnt
  join (select lang, sum(total) as total, max(v) as v from groups group by lang) g using (lang) group by lang, t),
terms as (select lang, source, 'term' as part, t as item, (p - q) * (p - q) // q as value from dense join spoken using (lang, t) where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= {top_terms}"""
