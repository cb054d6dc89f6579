"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.functions.text import bind
from linescope.llm import (
    context_tree,
    decontaminate,
    divergence,
    html_text,
    lines,
    minhash,
    neighbour_quality,
    oracles,
    pieces,
    private,
    quality_rules,
    runs,
    secrets,
    url_filter,
)
from linescope.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_minhash_near_dedup", oracles.NEAR_DEDUP)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op2_line_dedup", oracles.LINE_DEDUP)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = lines.without_boilerplate(docs, removed="n_removed")
    return out.select("doc_id", "text", "n_removed", F.length("text").cast("long").alias("n_chars"))


@query("op6_quality_rules", oracles.QUALITY_RULES)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return context_tree.score(table(spark, sf_dir, "documents"), held_out=held)


@query("op9_benchmark_decontamination", oracles.LEAKS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = neighbour_quality.score(docs, labels, ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: The rules of the contract.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query("op8_url_filters", oracles.url_verdicts(URL_RULES))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A page is labelled by the quality of the document that the last number of its path names.
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.withColumn("doc", F.expr("try_cast(regexp_extract(url, '([0-9]+)[^0-9/?#]*/?(?:[?#].*)?$', 1) as bigint)"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("doc")).agg(F.avg("quality").alias("label"))
    return url_filter.verdicts(named.join(labels, "doc", "left"), URL_RULES)


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@query("op7_secret_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def planted_period(key: Column, text: Column) -> Column:
    """The contract's texts: where crc32(key) ends in 0, the words behind a start drawn from it repeat with a drawn period."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def cyclic(h: Column, ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = g % n

        def at(i: Column) -> Column:
            period = F.floor((n - a) / (3 + g % 8)) + 1
            return F.get(ws, F.when(i >= a, a + (i - a) % period).otherwise(i).cast("int"))

        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), " ")).otherwise("")

    crc = F.crc32(key.cast("string"))
    return F.when(crc % 10 == 0, bind(cyclic, crc, words)).otherwise(text)


@query("op13_periodic_runs", oracles.periodic_runs(runs.LEAST, runs.POWER))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_period(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.periodic_runs(docs)
    # The greatest exponent compares as a whole number: length / period = quotient + rest / period.
    best = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).otherwise(1))
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)),
    )
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    held = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), told.alias("told"), F.get(best, F.lit(0)).alias("best"))
    return held.select(
        "doc_id",
        "n_runs",
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("told", lambda t: F.concat(t, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op11_source_divergence", oracles.divergence(divergence.MIN_DOCS, divergence.TOP_TERMS))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_personal_data")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def told(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in private.KINDS], F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))
