"""Input tables of the registered queries, derived from the given Parquet tables.

Each has a Spark form and the same rows as a SQL common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.functions.text import bind, split_lines
from linescope.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(key, code): one whole text per row."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("code"))
    return spread(docs, "key")


UNLABELLED = 4


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """(key, func_before, severity): all texts; ``UNLABELLED`` is the class of those without a label."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("func_before"))
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("key"), (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("severity")
    )
    return docs.join(labels, "key", "left").select(
        "key", "func_before", F.coalesce("severity", F.lit(UNLABELLED)).alias("severity")
    )


FUNCTIONS = f"""functions as (
  select d.doc_id as key, d.text as func_before, cast(coalesce(l.quality*2+l.toxic, {UNLABELLED}) as int) as severity
  from documents d left join labels l on d.doc_id = l.doc_id)"""

LINES = """x0 as (
  select doc_id as key, generate_subscripts(string_split(text, chr(10)), 1) as line_no,
         unnest(string_split(text, chr(10))) as line from documents)"""

# A line counts as changed when it holds a digit or is shorter than 24 characters.
CHANGED = "regexp_matches(line, '[0-9]') or length(line) < 24"


def _changed(line):
    return line.rlike("[0-9]") | (F.length(line) < 24)


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """(key, func_before, severity, vul_line) with the changed lines as text, NULL where none."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("key"), F.col("text").alias("func_before"), F.length("lang").alias("severity")
    )
    lines = split_lines(F.col("func_before"))
    numbered = F.transform(lines, lambda line, i: F.when(_changed(line), (i + 1).cast("string")))
    text = F.array_join(F.array_compact(numbered), " ")
    return spread(docs, "key").withColumn("vul_line", F.when(text != "", text))


VUL = LINES + f""",
vul as (select key, line_no from x0 where {CHANGED}),
n_lines as (select key, max(line_no) as n from x0 group by key)"""


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """(key, severity, func_before, vul_line): every sentence is a line that assigns its other words to its first one;
    lines with a digit or under 24 characters are marked."""
    docs = table(spark, sf, "documents")
    sentences = F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n", -1)
    lines = F.transform(sentences, lambda x: F.regexp_replace(x, "^([^ ]+) ", "$1 = "))
    rows = docs.select(F.col("doc_id").alias("key"), F.length("lang").alias("severity"), lines.alias("lines"))
    marks = F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike("[0-9]") | (F.length(x) < 24), (i + 1).cast("string"))))
    return spread(rows, "key").select("key", "severity", F.array_join("lines", "\n").alias("func_before"), F.array_join(marks, " ").alias("vul_line"))


ASSIGNED = """s0 as (select doc_id as key, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) as ls from documents),
x0 as (select key, generate_subscripts(ls, 1) as line_no, regexp_replace(unnest(ls), '^([^ ]+) ', '\\1 = ') as line from s0)"""


def commented(spark: SparkSession, sf: str) -> DataFrame:
    """(key, code): the texts with a comment form behind the lines, by line position."""

    def add(line, i):
        kind = (F.col("key") + i + 1) % 5
        tail = (
            F.when(kind == 0, " // note").when(kind == 1, " /* c */").when(kind == 2, "*/ x /* y").otherwise("")
        )
        return F.concat(line, tail)

    docs = documents(spark, sf)
    return docs.select("key", F.array_join(F.transform(split_lines(F.col("code"), "newline"), add), "\n").alias("code"))


COMMENTED = LINES + """,
x2 as (select key, line_no, concat(line, case (key+line_no)%5 when 0 then ' // note' when 1 then ' /* c */'
                                         when 2 then '*/ x /* y' else '' end) as line from x0)"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """(key, func_before, func, diff_func): every changed line is replaced by itself plus `` NEW``."""
    lines = split_lines(F.col("func_before"), "newline")
    after = F.transform(lines, lambda x: F.when(_changed(x), F.concat(x, F.lit(" NEW"))).otherwise(x))
    diff = F.transform(
        lines,
        lambda x: F.when(_changed(x), F.concat(F.lit("-"), x, F.lit("\n+"), x, F.lit(" NEW /* new */"))).otherwise(
            F.concat(F.lit(" "), x)
        ),
    )
    n = F.size(lines).cast("string")
    head = F.concat(F.lit("@@ -1,"), n, F.lit(" +1,"), n, F.lit(" @@\n"))
    base = documents(spark, sf).withColumnRenamed("code", "func_before")
    return base.withColumn("func", F.array_join(after, "\n")).withColumn(
        "diff_func", F.concat(head, F.array_join(diff, "\n"))
    )


HUNK_LINES = 10


def hunked(spark: SparkSession, sf: str) -> DataFrame:
    """(key, diff_func): a hunk for every ``HUNK_LINES`` lines; a changed line becomes two, so later hunks move down."""

    def body(lines):
        def part(line, i):
            before = F.size(F.filter(F.slice(lines, 1, i), _changed))
            n = F.least(F.lit(HUNK_LINES), F.size(lines) - i)
            more = F.size(F.filter(F.slice(lines, i + 1, n), _changed))
            head = F.format_string("@@ -%d,%d +%d,%d @@ more\n", i + 1, n, i + 1 + before, n + more)
            own = F.when(_changed(line), F.concat(F.lit("-"), line, F.lit("\n+"), line, F.lit(" NEW\n+"), line, F.lit(" MORE")))
            return F.concat(F.when(i % HUNK_LINES == 0, head).otherwise(""), own.otherwise(F.concat(F.lit(" "), line)))

        return F.array_join(F.transform(lines, part), "\n")

    return documents(spark, sf).select("key", bind(body, split_lines(F.col("code"), "newline")).alias("diff_func"))
