"""Function tables, scoped code, text export and result files."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from linescope.functions.text import single_line
from linescope.operators.results import multitask_to_long
from linescope.operators.splits import require_columns

FUNCTION_SCHEMA = StructType(
    [
        StructField("key", StringType()),
        StructField("func_before", StringType()),
        StructField("func", StringType()),
        StructField("diff_func", StringType()),
        StructField("severity", IntegerType()),
    ]
)


def read_functions(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Function table from Parquet; only the wanted columns are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


# Options that keep line ends, quotes, blanks and empty strings of code cells as they are.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_code_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV whose cells hold multi-line code; an empty cell is NULL.

    Such files cannot be split; convert them to Parquet once and work on that.
    """
    options = {**_CSV, "emptyValue": "", "multiLine": "true", "enforceSchema": "false"}
    return spark.read.schema(schema).options(**options).csv(path)


def write_code_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**_CSV).option("quoteAll", "true").csv(path)


def write_scopes(scoped: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scoped-code table, one folder per scope."""
    scoped.write.mode(mode).partitionBy("scope").parquet(path)


def read_scope(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """Rows of one scope; the other folders are not scanned."""
    return spark.read.parquet(path).where(F.col("scope") == scope)


def export_lines(df: DataFrame, label: str = "severity", text: str = "func_before") -> DataFrame:
    """One text line ``label<CODESPLIT>text`` per row."""
    require_columns(df, [label, text])
    return df.select(single_line(F.col(label), F.col(text)).alias("value"))


def write_lines(df: DataFrame, path: str, label: str = "severity", text: str = "func_before") -> None:
    export_lines(df, label, text).write.text(path)


# --- result files ------------------------------------------------------------------------


def _by_header(spark: SparkSession, path: str, schema: StructType, recursive: bool = False) -> DataFrame:
    """CSV files below ``path`` with every column found by the header of its own file, and ``_file``.

    Files are grouped by their header; columns that a file does not have are NULL, others are left out.
    """
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    firsts = lines.where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")
    )
    heads = firsts.groupBy("file").agg(F.min_by("value", "at").alias("head")).collect()
    wanted = {f.name: f for f in schema.fields}
    files: dict[str, list[str]] = {}
    for row in heads:
        files.setdefault(row["head"], []).append(unquote(row["file"]))
    out = spark.createDataFrame([], StructType([*schema.fields, StructField("_file", StringType())]))
    for head, paths in sorted(files.items()):
        names = next(csv.reader([head]))
        own = StructType([wanted.get(n, StructField(n, StringType())) for n in names])
        rows = spark.read.schema(own).option("header", "true").csv(paths)
        known = [F.col(f"`{n}`") for n in names if n in wanted]
        out = out.unionByName(rows.select(*known, F.col("_metadata.file_path").alias("_file")), allowMissingColumns=True)
    return out


def append_results(rows: DataFrame, path: str) -> None:
    """Add result rows to a result folder; every part carries the header."""
    rows.write.mode("append").option("header", "true").csv(path)


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All result sets below ``path`` whose name begins with ``r``, columns by name."""
    return _by_header(spark, f"{path}/r*", schema).drop("_file")


def source_name(path: Column) -> Column:
    """Name of the result set a row was read from.

    The file name, or the folder where the file is a part written by Spark; a ``column=`` prefix
    is cut.
    """
    parts = F.split(path, "/")
    last, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    name = F.when(last.startswith("part-"), folder).otherwise(last)
    return F.regexp_replace(name, "^[A-Za-z0-9]+=", "")


def _read_named(spark: SparkSession, path: str, schema: StructType, parts: int) -> DataFrame:
    files = _by_header(spark, path, schema, recursive=True)
    named = files.withColumn("_parts", F.split(source_name(F.col("_file")), "_")).drop("_file")
    return named.where(F.size("_parts") == parts)


def read_multitask_files(spark: SparkSession, path: str, schema: StructType, avg: bool = False) -> DataFrame:
    """Multitask results in long form, with type, scope, token and fold from names of five parts."""
    named = _read_named(spark, path, schema, 5)
    fields = ["feature_type", "feature_scope", "token", "fold"]
    tagged = named.select(
        *[F.col(f.name) for f in schema.fields if f.name != "fold"],
        *[F.get("_parts", F.lit(i)).alias(n) for i, n in enumerate(fields)],
    )
    ids = ["run", "set", *fields]
    rows = multitask_to_long(tagged, avg=False, ids=ids)
    if not avg:
        return rows
    metrics = [c for c in rows.columns if c not in [*ids, "scenario"]]
    return rows.groupBy("scenario", *fields).agg(*[F.avg(c).alias(c) for c in metrics])


def read_sequential_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Single-task results with the scenario from names of seven parts; the fourth must be ``cvss2``."""
    named = _read_named(spark, path, schema, 7)
    checked = F.when(F.get("_parts", F.lit(3)) == "cvss2", F.concat_ws("_", F.get("_parts", F.lit(3)), F.get("_parts", F.lit(4)))).otherwise(
        F.raise_error(F.concat(F.lit("not a cvss2 result set: "), F.concat_ws("_", "_parts")))
    )
    return named.select(
        checked.alias("scenario"),
        *[F.get("_parts", F.lit(i)).alias(n) for i, n in [(0, "feature_type"), (1, "feature_scope"), (2, "token"), (5, "fold")]],
        *[F.col(f.name) for f in schema.fields if f.name != "fold"],
    )


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment list ``granularity,scope,problem,feature`` from a CSV without header."""
    return spark.read.schema("granularity string, scope string, problem string, feature string").csv(path)
