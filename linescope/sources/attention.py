"""Reading and writing attention dumps and token weight files.

A dump holds per function a file ``tokens`` (one token per line) and files ``layer_<n>`` (one
statement per line: a list with one weight per token). Each file is one function, so it is read as
one row; everything behind that is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescope.functions.rows import inlined
from linescope.functions.text import bind
from linescope.functions.vectors import parse_vector
from linescope.operators.attention import ranking_lines, trim_row

SEPARATOR = "  ||  "


def read_dump_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): every file of a dump, whole."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def _until_blank(lines: Column, blank: Column) -> Column:
    return bind(
        lambda all_lines, at: F.when(at > 0, F.slice(all_lines, F.lit(1), at - 1)).otherwise(all_lines),
        lines,
        F.array_position(blank, True).cast("int"),
    )


def dump_tokens(files: DataFrame) -> DataFrame:
    """(func_id, tokens) from the ``tokens`` files; reading stops at the first empty line."""
    lines = F.split("value", "\n", -1)
    kept = _until_blank(lines, F.transform(lines, lambda x: x == ""))
    func = F.regexp_extract("path", "([0-9]+)/tokens$", 1)
    return files.where(func != "").select(func.cast("bigint").alias("func_id"), kept.alias("tokens"))


def dump_weights(files: DataFrame) -> DataFrame:
    """(func_id, layer, stmt_id, weights) from the ``layer_<n>`` files.

    Reading stops at the first blank line; tensor wrappers are removed and lines that are no list
    of numbers are skipped.
    """
    func = F.regexp_extract("path", "([0-9]+)/layer_[0-9]+$", 1)
    layer = F.regexp_extract("path", "/layer_([0-9]+)$", 1)
    lines = F.transform(F.split("value", "\n", -1), F.trim)
    kept = _until_blank(lines, F.transform(lines, lambda x: x == ""))

    def parsed(line: Column, at: Column) -> Column:
        bare = F.replace(F.replace(line, F.lit("tensor("), F.lit("")), F.lit(", device='cuda:0')"), F.lit(""))
        return F.struct((at + 1).alias("stmt_id"), parse_vector(bare).alias("weights"))

    named = files.where(func != "")
    ids = [func.cast("bigint").alias("func_id"), layer.cast("int").alias("layer")]
    return inlined(named, ids, F.transform(kept, parsed), "weights")


def statement_table(files: DataFrame) -> DataFrame:
    """Statement table of a dump; statements without any weight are skipped."""
    joined = dump_weights(files).join(dump_tokens(files), "func_id")
    row = trim_row(F.col("tokens"), F.col("weights"))
    return inlined(joined, ["func_id", "layer", "stmt_id"], F.array(row), "start")


def token_weight_lines(weights: DataFrame) -> DataFrame:
    """Lines ``token  ||  weight`` by ascending weight."""
    return weights.orderBy("weight", "token").select(ranking_lines(F.col("token"), F.col("weight")).alias("value"))


def parse_token_weights(lines: DataFrame) -> DataFrame:
    """(token, weight) from such lines; the last of several entries of one token wins."""
    parts = F.split("value", "  \\|\\|  ", -1)
    rows = lines.where(F.trim("value") != "").select(
        F.get(parts, F.lit(0)).alias("token"),
        F.get(parts, F.lit(1)).cast("double").alias("weight"),
        F.monotonically_increasing_id().alias("at"),
    )
    return rows.groupBy("token").agg(F.max_by("weight", "at").alias("weight"))


def write_token_weights(weights: DataFrame, path: str) -> None:
    token_weight_lines(weights).write.text(path)


def read_token_weights(spark: SparkSession, path: str) -> DataFrame:
    return parse_token_weights(spark.read.text(path))


def statement_listing(statements: DataFrame) -> DataFrame:
    """(func_id, stmt_id, value): the token list and the weight of each statement as two lines."""

    def quoted(t: Column) -> Column:
        escaped = F.replace(t, F.lit("\\"), F.lit("\\\\"))
        double = t.contains("'") & ~t.contains('"')
        single = F.replace(escaped, F.lit("'"), F.lit("\\'"))
        return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), single, F.lit("'"))
        )

    tokens = F.concat(F.lit("["), F.array_join(F.transform("tokens", quoted), ", "), F.lit("]"))
    return statements.select(
        "func_id", "stmt_id", F.concat(tokens, F.lit("\n"), F.col("weight").cast("string")).alias("value")
    )


def write_listing(statements: DataFrame, path: str, folders: int = 64) -> None:
    """Statement listing as text, the functions spread over a fixed number of folders."""
    rows = statement_listing(statements).withColumn("folder", F.pmod(F.xxhash64("func_id"), F.lit(folders)))
    # Range partitions cut inside a function too, so a very large one is written by many tasks.
    ordered = rows.repartitionByRange("folder", "func_id", "stmt_id").sortWithinPartitions("folder", "func_id", "stmt_id")
    ordered.select("folder", "value").write.partitionBy("folder").text(path)
