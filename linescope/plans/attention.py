"""Section E: attention analytics and code simplification, and the attention sources of section A."""

from __future__ import annotations

from pyspark.sql import functions as F

from linescope import session
from linescope.functions import text as T
from linescope.functions.rows import exploded, inlined
from linescope.functions.text import bind
from linescope.operators import attention as A
from linescope.operators import simplify as S
from linescope.plans import inputs as I
from linescope.plans.registry import query
from linescope.sources import attention as D


def statements(spark, sf):
    """Statement table over all texts: a line is a statement, its words are cut to pieces of four.

    Weights follow from the ids; every 23rd is zero, which makes gaps inside statements.
    """

    # Every word and every line begins with the mark; line ends stand among the tokens.
    marked = F.concat(F.lit(T.SPACE_MARK), F.replace(F.replace("code", F.lit(" "), F.lit(T.SPACE_MARK)), F.lit("\n"), F.lit("\n" + T.SPACE_MARK)))
    pattern = f"\n|{T.SPACE_MARK}?[^\n{T.SPACE_MARK}]{{1,4}}"
    cut = I.documents(spark, sf).select(F.col("key").alias("func_id"), F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)).alias("all"))

    def lines(ends):
        """Number, first token and size of every line with a token, from the places of the line ends."""

        def line(end, i):
            before = F.coalesce(F.get(ends, i - 1), F.lit(-1))
            return F.struct((i + 1).alias("stmt_id"), (before + 2 - i).alias("start"), (end - before - 1).alias("n"))

        return F.filter(F.transform(ends, line), lambda s: s["n"] > 0)

    ends = F.concat(F.array_compact(F.transform("all", lambda t, i: F.when(t == "\n", i))), F.array(F.size("all")))
    docs = cut.select("func_id", F.array_remove("all", "\n").alias("own"), bind(lines, ends).alias("lines"))
    # A slice holds the first token of the next line too.
    tokens = F.slice("own", F.col("start"), F.col("n") + 1).alias("tokens")
    rows = inlined(docs, ["func_id", "own"], F.col("lines"), "stmt_id").select("func_id", "stmt_id", "start", "n", tokens)
    layered = rows.withColumn("layer", F.explode(F.array(F.lit(10), F.lit(11))))
    first = F.col("func_id") * 31 + F.col("stmt_id") * 7 + F.col("layer") * 13 + 17
    numbers = F.sequence(first, first + (F.col("n") - 1) * 17, F.lit(17).cast("bigint"))
    numbered = layered.select("*", numbers.alias("numbers"), (F.col("func_id") + F.col("stmt_id") + 1).alias("place"))

    def weight(x, i):
        return F.when((F.col("place") + i) % 23 == 0, F.lit(0.0)).otherwise((x % 97 + 1) / F.lit(997.0))

    # Without an id there are no weights; the token of the next line has none of this one.
    own = F.coalesce(F.transform("numbers", weight), F.array_repeat(F.lit(None).cast("double"), F.col("n")))
    weights = F.concat(own, F.array_repeat(F.lit(0.0), F.size("tokens") - F.col("n")))
    return numbered.select("func_id", "layer", "stmt_id", "start", "tokens", weights.alias("weights"))


STATEMENTS = I.LINES + f""",
xw as (select key, line_no, generate_subscripts(string_split(line, ' '), 1) as word_no, unnest(string_split(line, ' ')) as word from x0),
xp as (select key, line_no, word_no, word, unnest(range((length(word) - 1) // 4 + 1)) as n from xw where word <> ''),
xt as (select key as func_id, line_no as stmt_id, row_number() over (partition by key, line_no order by word_no, n) as pos,
         concat(case when n = 0 then '{T.SPACE_MARK}' else '' end, substr(word, n * 4 + 1, 4)) as token from xp),
ends as (select func_id, stmt_id, max(pos) as n, arg_min(token, pos) as head from xt group by func_id, stmt_id),
nexts as (select func_id, stmt_id, n, lead(head) over w as after_token,
            1 + coalesce(sum(n) over (partition by func_id order by stmt_id rows between unbounded preceding and 1 preceding), 0) as start
          from ends window w as (partition by func_id order by stmt_id)),
att as (
  select t.func_id, l.layer, t.stmt_id, t.pos, t.token,
    case when (t.func_id + t.stmt_id + t.pos) % 23 = 0 then 0e0
         else ((t.func_id * 31 + t.stmt_id * 7 + t.pos * 17 + l.layer * 13) % 97 + 1) / 997e0 end as w
  from xt t cross join (select 10 as layer union all select 11) l
  union all
  select func_id, layer, stmt_id, n + 1, after_token, 0e0 from nexts
  cross join (select 10 as layer union all select 11) l where after_token is not null),
att11 as (select * from att where layer = 11)"""

# First run of non-zero weights.
RUN_PARTS = """run_firsts as (select func_id, stmt_id, min(pos) as f from att11 where w <> 0 group by func_id, stmt_id),
zeros as (select a.func_id, a.stmt_id, min(a.pos) as z from att11 a
          join run_firsts f on f.func_id = a.func_id and f.stmt_id = a.stmt_id
          where a.w = 0 and a.pos > f.f group by a.func_id, a.stmt_id),
run as (select a.* from att11 a join run_firsts f on f.func_id = a.func_id and f.stmt_id = a.stmt_id
        left join zeros z on z.func_id = a.func_id and z.stmt_id = a.stmt_id
        where a.pos >= f.f and a.pos < coalesce(z.z, 1000000000))"""
RUNS = STATEMENTS + ", " + RUN_PARTS

WORDS = STATEMENTS + f""",
firsts as (select func_id, stmt_id, min(pos) as f, max(pos) as last_pos from att11 where w <> 0 group by func_id, stmt_id),
seen as (select a.*, f.f, lag(w) over (partition by a.func_id, a.stmt_id order by pos) as prev_w
         from att11 a join firsts f on f.func_id = a.func_id and f.stmt_id = a.stmt_id),
stops as (select func_id, stmt_id, min(pos) as stop from seen
          where pos > f and w = 0 and (prev_w = 0 or token like '{T.SPACE_MARK}%') group by func_id, stmt_id),
kept as (select s.*, sum(case when s.pos = s.f or token like '{T.SPACE_MARK}%' or prev_w = 0 then 1 else 0 end)
           over (partition by s.func_id, s.stmt_id order by s.pos) as word_no
         from seen s left join stops p on p.func_id = s.func_id and p.stmt_id = s.stmt_id
         where s.pos >= s.f and s.pos < coalesce(p.stop, 1000000000) and s.w <> 0),
words as (select func_id, stmt_id, cast(word_no as int) as word_no,
            regexp_replace(string_agg(token, '' order by pos), '^{T.SPACE_MARK}', '') as word, avg(w) as weight, max(pos) as last_pos
          from kept group by func_id, stmt_id, word_no)"""

# Camel pieces without look-ahead: cut runs first, then split a letter run that holds a capital.
_PIECES = r"""unnest(flatten(list_transform(regexp_extract_all(word, '[a-zA-Z]+|\p{Nd}+|_+|[^\p{L}\p{N}_]+'), lambda r:
  case when regexp_matches(r, '^[a-zA-Z]+$') and regexp_matches(r, '[A-Z]')
  then list_filter([regexp_extract(r, '^(.*)[A-Z][a-z]*$', 1),
                    case when regexp_matches(r, '[A-Z]$') then right(r, 1) else regexp_extract(r, '[a-z]*$') end], lambda x: x <> '')
  else [r] end)))"""

PIECE_WEIGHTS = WORDS + f""",
pieces as (select {_PIECES} as token, weight from words),
tw as (select token, avg(weight) as weight, count(*) as frequency from pieces group by token)"""


def weights(spark, sf):
    rows = A.layer_mean(statements(spark, sf))
    return A.token_weights(A.words(rows))


def rounded(df, digits=9):
    return df.withColumn("weight", F.round("weight", digits))


def _dump_files(spark, sf):
    """Dump files derived from the conversations: one function per turn, layer 11 wrapped as a tensor."""
    talk = I.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("func_id"), F.split("text", "\n", -1).alias("lines")
    )
    numbered = F.transform(
        "lines",
        lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct((i + 1).alias("stmt"), w.alias("w"))),
    )
    flat = talk.select("func_id", F.flatten(numbered).alias("toks"), F.size("lines").alias("n"))

    def cell(s, i, stmt):
        return F.when(s["stmt"] != stmt, F.lit("0.0")).otherwise((((i + 1) % 7 + F.col("func_id") % 5) / F.lit(8.0)).cast("string"))

    def row(stmt):
        cells = F.array_join(F.transform("toks", lambda s, i: cell(s, i, stmt)), ", ")
        return F.when(stmt % 4 == 0, F.concat(F.lit("[broken, "), cells, F.lit("]"))).otherwise(
            F.concat(F.lit("tensor(["), cells, F.lit("], device='cuda:0')"))
        )

    layer = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), row), "\n"), F.lit("\n\n[9.0]\n"))
    tokens = F.concat(F.array_join(F.transform("toks", lambda s: s["w"]), "\n"), F.lit("\n"))
    ident = F.col("func_id").cast("string")
    return flat.where(F.size("toks") > 0).select(
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("dump/"), ident, F.lit("/tokens")).alias("path"), tokens.alias("value")),
                F.struct(F.concat(F.lit("dump/"), ident, F.lit("/layer_11")).alias("path"), layer.alias("value")),
            )
        )
    )


@query("a05_attention_dump", """with l as (
  select conv_id * 1000 + turn as func_id, generate_subscripts(string_split(text, chr(10)), 1) as stmt, unnest(string_split(text, chr(10))) as line
  from conversations),
w as (select func_id, stmt, generate_subscripts(string_split(line, ' '), 1) as word_no, unnest(string_split(line, ' ')) as token from l),
t as (select func_id, stmt, token, row_number() over (partition by func_id order by stmt, word_no) as pos from w where token <> ''),
v as (select func_id, stmt as stmt_id, pos, token, (pos % 7 + func_id % 5) / 8e0 as weight from t where stmt % 4 <> 0)
select func_id, cast(11 as int) as layer, cast(stmt_id as int) as stmt_id, cast(min(pos) as int) as start,
  arg_min(token, pos) as first_token, round(sum(weight), 6) as total from v where weight <> 0 group by func_id, stmt_id""")
def a05(spark, sf):
    table = D.statement_table(_dump_files(spark, sf))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return table.select(
        "func_id", "layer", "stmt_id", "start", F.get("tokens", F.lit(0)).alias("first_token"), F.round(total, 6).alias("total")
    )


@query("a06_skip_last_function", f"""with {STATEMENTS}
select func_id, count(distinct stmt_id) as statements from att11 where func_id < (select max(func_id) from att11) group by func_id""")
def a06(spark, sf):
    rows = A.skip_last_function(A.layer_mean(statements(spark, sf)))
    return rows.groupBy("func_id").agg(F.count(F.lit(1)).alias("statements"))


@query("a07_token_weight_lookup", f"""with {PIECE_WEIGHTS}, {RUN_PARTS}
select t.token, t.n, round(coalesce(w.weight, 0e0), 6) as global_weight from (
  select regexp_replace(token, '^{T.SPACE_MARK}', '') as token, count(*) as n from run group by 1) t
left join tw w on w.token = t.token""")
def a07(spark, sf):
    spans = A.statement_spans(A.layer_mean(statements(spark, sf)))
    tokens = exploded(spans, [], F.transform("span_tokens", A.bare_token), "token")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return A.lookup(counts, weights(spark, sf)).withColumn("global_weight", F.round("global_weight", 6))


@query("a08_token_weight_lines", f"""with {PIECE_WEIGHTS} select token, round(weight, 6) as weight from tw""")
def a08(spark, sf):
    path = session.fresh_path(spark, "token-weights")
    D.write_token_weights(weights(spark, sf), path)
    return D.read_token_weights(spark, path).select("token", F.round("weight", 6).alias("weight"))


@query("e01_layer_mean", f"""with {STATEMENTS},
m as (select func_id, stmt_id, pos, sum(w) / 2e0 as w from att group by func_id, stmt_id, pos)
select func_id, cast(stmt_id as int) as stmt_id, count(*) as n, round(sum(w), 6) as total, round(max(w), 6) as largest
from m group by func_id, stmt_id""")
def e01(spark, sf):
    rows = A.weight_rows(A.layer_mean(statements(spark, sf), layers=(10, 11)))
    return rows.groupBy("func_id", "stmt_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest")
    )


@query("e02_statement_spans", f"""with {RUNS}
select r.func_id, cast(r.stmt_id as int) as stmt_id, cast(min(r.pos) + min(n.start) - 1 as int) as span_start,
  cast(count(*) as int) as n, string_agg(r.token, ' ' order by r.pos) as tokens, round(sum(r.w), 6) as total
from run r join nexts n on n.func_id = r.func_id and n.stmt_id = r.stmt_id group by r.func_id, r.stmt_id""")
def e02(spark, sf):
    total = F.aggregate("span_weights", F.lit(0.0), lambda a, x: a + x)
    return A.statement_spans(A.layer_mean(statements(spark, sf))).select(
        "func_id",
        "stmt_id",
        "span_start",
        F.size("span_tokens").alias("n"),
        F.array_join("span_tokens", " ").alias("tokens"),
        F.round(total, 6).alias("total"),
    )


_WORD_COLS = "func_id, cast(stmt_id as int) as stmt_id, word_no, word, round(weight, 6) as weight"


@query("e03_words", f"with {WORDS} select {_WORD_COLS} from words")
def e03(spark, sf):
    return rounded(A.words(A.layer_mean(statements(spark, sf))), 6)


@query("e03_words_legacy_tail", f"""with {WORDS},
row_end as (select func_id, stmt_id, max(pos) as n from att11 group by func_id, stmt_id)
select w.func_id, cast(w.stmt_id as int) as stmt_id, w.word_no, w.word, round(w.weight, 6) as weight
from words w join row_end r on r.func_id = w.func_id and r.stmt_id = w.stmt_id where w.last_pos < r.n""")
def e03_legacy(spark, sf):
    return rounded(A.words(A.layer_mean(statements(spark, sf)), legacy_tail=True), 6)


_CAMEL_INPUT = I.LINES + """,
cw as (select key, line_no, generate_subscripts(string_split(line, ' '), 1) as word_no, unnest(string_split(line, ' ')) as w from x0),
words as (select w || translate(substr(nw, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || substr(nw, 2)
            || '_' || key || translate(nw, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as word, 1e0 as weight
          from (select *, lead(w) over (partition by key, line_no order by word_no) as nw from cw) where nw is not null)"""


@query("e04_camel_split", f"""with {_CAMEL_INPUT}, pieces as (select {_PIECES} as piece from words)
select piece, count(*) as n from pieces group by piece""")
def e04(spark, sf):
    docs = I.documents(spark, sf)
    line_words = F.transform(T.split_lines(F.col("code"), "newline"), lambda x: F.split(x, " ", -1))
    rows = exploded(docs, ["key"], line_words, "ws")
    pairs = F.arrays_zip(F.slice("ws", F.lit(1), F.size("ws") - 1).alias("a"), F.slice("ws", F.lit(2), F.size("ws")).alias("b"))
    joined = rows.select("key", F.inline_outer(pairs).alias("a", "b")).where(F.col("a").isNotNull())
    def capital(c):
        return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    head, tail = capital(F.substring("b", 1, 1)), F.substr("b", F.lit(2))
    word = F.concat("a", head, tail, F.lit("_"), F.col("key").cast("string"), capital(F.col("b")))
    pieces = exploded(joined, [], T.camel_pieces(word), "piece")
    return pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


@query("e05_token_weights", f"with {PIECE_WEIGHTS} select token, round(weight, 6) as weight, frequency from tw")
def e05(spark, sf):
    return rounded(weights(spark, sf), 6)


@query("e06_low_rated_tokens", f"with {PIECE_WEIGHTS} select token from tw order by round(weight, 9), token limit {A.LOW_RATED}")
def e06(spark, sf):
    return A.low_rated_tokens(rounded(weights(spark, sf)))


STATEMENT_WEIGHTS = PIECE_WEIGHTS + ", " + RUN_PARTS + f""",
bare as (select func_id, stmt_id, pos, regexp_replace(token, '^{T.SPACE_MARK}', '') as token, w from run),
sw as (select b.func_id, b.stmt_id, count(*) as n, avg(0.7e0 * b.w + (1e0 - 0.7e0) * coalesce(t.weight, 0e0)) as weight,
         replace(string_agg(b.token, ' ' order by b.pos), '{T.SPACE_MARK}', '') as text
       from bare b left join tw t on t.token = b.token group by b.func_id, b.stmt_id)"""


def weighted_statements(spark, sf):
    # Words and spans both read the parsed statements, so a text is parsed once.
    rows = session.materialise(A.layer_mean(statements(spark, sf)), "statements")
    return A.statement_weights(rows, A.token_weights(A.words(rows)))


@query("e07_statement_weights", f"""with {STATEMENT_WEIGHTS}
select func_id, cast(stmt_id as int) as stmt_id, cast(n as int) as n, text, round(weight, 6) as weight from sw""")
def e07(spark, sf):
    return weighted_statements(spark, sf).select(
        "func_id",
        "stmt_id",
        F.size("tokens").alias("n"),
        A.statement_text(F.col("tokens")).alias("text"),
        F.round("weight", 6).alias("weight"),
    )


@query("e08_statement_listing", f"""with {STATEMENT_WEIGHTS}
select func_id, cast(stmt_id as int) as stmt_id, '[' || string_agg(case when contains(token, '''') and not contains(token, '"')
    then '"' || replace(token, chr(92), chr(92) || chr(92)) || '"'
    else '''' || replace(replace(token, chr(92), chr(92) || chr(92)), '''', chr(92) || '''') || '''' end, ', ' order by pos) || ']' as value
from bare group by func_id, stmt_id""")
def e08(spark, sf):
    listing = D.statement_listing(weighted_statements(spark, sf))
    return listing.withColumn("value", F.get(F.split("value", "\n"), F.lit(0)))


@query("e08_statement_listing_files")
def e08_files(spark, sf):
    path = session.fresh_path(spark, "statement-listing")
    D.write_listing(weighted_statements(spark, sf), path)
    return spark.read.text(path).groupBy("folder").agg(F.count(F.lit(1)).alias("lines"))


@query("e09_statement_ranking", f"""with {STATEMENT_WEIGHTS}
select func_id, cast(stmt_id as int) as stmt_id, text, round(weight, 6) as weight from sw where text <> '}}'""")
def e09(spark, sf):
    return rounded(A.statement_ranking(weighted_statements(spark, sf)), 6)


_KEYWORDS = ", ".join(f"'{k}'" for k in A.CPP_KEYWORDS)


@query("e10_keyword_profile", f"""with {PIECE_WEIGHTS}
select frequency, round(avg(weight), 6) as weight, min(token) as name, count(*) as repeats, frequency * 150 as x
from tw where token in ({_KEYWORDS}) group by frequency""")
def e10(spark, sf):
    return rounded(A.keyword_profile(weights(spark, sf)), 6)


@query("e11_marked_merge", f"""with {PIECE_WEIGHTS}
select token, round(sum(frequency * weight) / sum(frequency), 6) as weight, cast(sum(frequency) as bigint) as frequency
from tw where contains(token, '{T.SPACE_MARK}') group by token""")
def e11(spark, sf):
    return rounded(A.merge_marked(weights(spark, sf)), 6)


@query("e11_marked_merge_raw_tokens", f"""with {STATEMENTS}
select token, round(avg(w), 6) as weight, count(*) as frequency from att11
where contains(token, '{T.SPACE_MARK}') and w <> 0 group by token""")
def e11_raw(spark, sf):
    rows = A.weight_rows(A.layer_mean(statements(spark, sf))).where(F.col("weight") != 0.0)
    raw = rows.groupBy("token").agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("frequency"))
    return rounded(A.merge_marked(raw), 6)


@query("e12_cloud_counts", f"""with {PIECE_WEIGHTS}
select token, substr(token, 2) as text, greatest(cast(trunc(log2(round(weight, 9) * 100000e0)) as int), 0) as copies
from tw where frequency > 100""")
def e12(spark, sf):
    return A.cloud_counts(rounded(weights(spark, sf)))


_SIMPLIFY = STATEMENT_WEIGHTS + f""",
low as (select token from tw order by round(weight, 9), token limit {A.LOW_RATED}),
sizes as (select func_id, cast(sum(n) as bigint) as size from sw group by func_id),
drops as (select func_id, stmt_id, n, sum(n) over (partition by func_id order by round(weight, 9), md5(concat_ws(':', '42', stmt_id))
            rows between unbounded preceding and current row) as gone from sw),
stmts as (select d.func_id, d.stmt_id from drops d join sizes s on s.func_id = d.func_id where s.size - d.gone < ceil(0.6e0 * s.size)),
toks as (select func_id, stmt_id, row_number() over (partition by func_id, stmt_id order by pos) as pos, token from bare),
rated as (select k.*, row_number() over (partition by k.func_id order by
              md5(concat_ws(':', '42', concat_ws(':', k.func_id, k.stmt_id, k.pos)))) as random_rank,
            row_number() over (partition by k.func_id order by coalesce(t.frequency, 0),
              md5(concat_ws(':', '42', concat_ws(':', k.func_id, k.stmt_id, k.pos)))) as freq_rank
          from toks k left join tw t on t.token = k.token)"""
_KEPT = """ select func_id, cast(stmt_id as int) as stmt_id, count(*) as kept, cast(sum(pos) as bigint) as places,
  min(token) as first_token from remaining group by func_id, stmt_id"""


def _simplified(spark, sf, strategy):
    # The tables feed several branches, so they are written once.
    rows = session.materialise(A.layer_mean(statements(spark, sf)), "statements")
    tokens = session.materialise(A.token_weights(A.words(rows)), "token-table")
    ranked = session.materialise(rounded(A.statement_weights(rows, tokens)), "statement-weights")
    tokens = rounded(tokens)
    kept = S.simplify(ranked, tokens, strategy, 0.6)
    return kept.groupBy("func_id", "stmt_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("pos").alias("places"), F.min("token").alias("first_token")
    )


@query("e13_simplify_statement", f"""with {_SIMPLIFY}, remaining as (
  select t.* from toks t join stmts s on s.func_id = t.func_id and s.stmt_id = t.stmt_id) {_KEPT}""")
def e13_statement(spark, sf):
    return _simplified(spark, sf, "statement")


@query("e13_simplify_token", f"""with {_SIMPLIFY}, remaining as (
  select * from toks where token not in (select token from low)) {_KEPT}""")
def e13_token(spark, sf):
    return _simplified(spark, sf, "token")


@query("e13_simplify_slim", f"""with {_SIMPLIFY}, remaining as (
  select t.* from toks t join stmts s on s.func_id = t.func_id and s.stmt_id = t.stmt_id
  where token not in (select token from low)) {_KEPT}""")
def e13_slim(spark, sf):
    return _simplified(spark, sf, "slim")


@query("e13_simplify_random", f"""with {_SIMPLIFY}, remaining as (
  select r.* from rated r join sizes s on s.func_id = r.func_id where r.random_rank <= ceil(0.6e0 * s.size)) {_KEPT}""")
def e13_random(spark, sf):
    return _simplified(spark, sf, "random")


@query("e13_simplify_frequency", f"""with {_SIMPLIFY}, remaining as (
  select r.* from rated r join sizes s on s.func_id = r.func_id where r.freq_rank > s.size - ceil(0.6e0 * s.size)) {_KEPT}""")
def e13_frequency(spark, sf):
    return _simplified(spark, sf, "frequency")
