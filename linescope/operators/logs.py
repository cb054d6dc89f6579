"""Training logs: one row per log with its whole text, parsed by splitting at its markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.rows import exploded
from linescope.functions.text import bind

# Markers and expected structure of a log.
PARTITION_MARK = "Current partition:"
RUN_MARK = "Run # "
EPOCH_MARK = "Epoch "
EVALUATION_MARK = "Evaluating the best model"
BEST_MARK = "Saving best model at epoch"
VALIDATION_MARK = "Validation time: "
LOSS_MARK = "loss: "
NUMBER = "[-+]?\\d*\\.\\d+|\\d+"
PARTITIONS = 10
RUNS = 10


def _after_first(text: Column, mark: str) -> Column:
    return bind(lambda parts: F.slice(parts, F.lit(2), F.size(parts)), F.split(text, mark, -1))


def _numbers_in_line(lines: Column, mark: str) -> Column:
    """Struct of how many lines carry the mark and the numbers in the first of them."""
    return bind(
        lambda hit: F.struct(
            F.size(hit).alias("lines"),
            F.regexp_extract_all(F.coalesce(F.get(hit, F.lit(0)), F.lit("")), F.lit(NUMBER), F.lit(0)).alias("numbers"),
        ),
        F.filter(lines, lambda x: x.contains(mark)),
    )


def _epoch(text: Column) -> Column:
    lines = F.split(text, "\n", -1)

    def build(rows: Column) -> Column:
        loss = F.filter(rows, lambda x: x.contains(LOSS_MARK))
        took = F.regexp_extract(F.coalesce(F.get(F.split(F.get(loss, F.lit(0)), " - "), F.lit(1)), F.lit("")), "^(\\d+)s$", 1)
        val = _numbers_in_line(rows, VALIDATION_MARK)
        head = F.get(rows, F.lit(0))
        return F.struct(
            F.regexp_extract(head, "^(\\d+)/", 1).try_cast("int").alias("epoch"),
            F.regexp_extract(head, "/(\\d+)", 1).try_cast("int").alias("planned"),
            took.try_cast("int").alias("seconds"),
            F.get(val["numbers"], F.lit(0)).try_cast("double").alias("val_seconds"),
            F.size(loss).alias("loss_lines"),
            (val["lines"] * 100 + F.size(val["numbers"])).alias("val_shape"),
            text.contains(BEST_MARK).alias("best"),
        )

    return bind(build, lines)


def log_runs(logs: DataFrame) -> DataFrame:
    """(log_id, partition, run, n_partitions, n_runs, sections, epochs, final): one row per run."""
    partitions = logs.select("log_id", _after_first(F.col("value"), PARTITION_MARK).alias("parts")).select(
        "log_id", F.size("parts").alias("n_partitions"), F.posexplode_outer("parts").alias("partition", "part")
    )
    runs = partitions.select(
        "log_id", "n_partitions", "partition", _after_first(F.col("part"), RUN_MARK).alias("runs")
    ).select("log_id", "n_partitions", "partition", F.size("runs").alias("n_runs"), F.posexplode_outer("runs").alias("run", "text"))
    cut = runs.withColumn("s", F.split("text", EVALUATION_MARK, -1))
    final = _numbers_in_line(F.split(F.coalesce(F.get("s", F.lit(2)), F.lit("")), "\n", -1), VALIDATION_MARK)
    epochs = F.transform(_after_first(F.get("s", F.lit(0)), EPOCH_MARK), _epoch)
    return cut.select(
        "log_id",
        "partition",
        "run",
        "n_partitions",
        "n_runs",
        F.size("s").alias("sections"),
        epochs.alias("epochs"),
        final.alias("final"),
    )


def log_epochs(logs: DataFrame) -> DataFrame:
    """(log_id, partition, run, epoch, seconds, val_seconds, best), one row per epoch."""
    return exploded(log_runs(logs), ["log_id", "partition", "run"], F.col("epochs"), "e").select(
        "log_id", "partition", "run", "e.epoch", "e.seconds", "e.val_seconds", "e.best"
    )


def log_violations(logs: DataFrame) -> DataFrame:
    """(log_id, partition, run, violation): every broken assumption about the structure of a log."""
    e = F.col("epochs")
    in_order = F.forall(
        F.sequence(F.lit(1), F.size(e)), lambda i: (i == 1) | (F.get(e, i - 1)["epoch"] == F.get(e, i - 2)["epoch"] + 1)
    )
    rules = {
        "partitions": F.col("n_partitions") != PARTITIONS,
        "runs": F.col("n_runs") != RUNS,
        "evaluation sections": F.col("sections") != 3,
        "epoch order": ~in_order,
        "planned epochs": F.size(F.array_distinct(F.transform(e, lambda x: x["planned"]))) != 1,
        "loss lines": F.exists(e, lambda x: x["loss_lines"] != 1),
        "epoch seconds": F.exists(e, lambda x: x["seconds"].isNull()),
        "validation seconds": F.exists(e, lambda x: x["val_shape"] != 101),
        "final evaluation": (F.col("final.lines") != 1) | (F.size("final.numbers") != 1),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return exploded(log_runs(logs), ["log_id", "partition", "run"], broken, "violation")


def run_timing(logs: DataFrame) -> DataFrame:
    """Times per run: mean per epoch, best epoch, totals to the best epoch and to the finish.

    A run that never saved a best model has NULL there.
    """

    def total(name: str, until: Column | None = None) -> Column:
        kept = F.col("epochs") if until is None else F.slice("epochs", F.lit(1), until)
        return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x[name])

    saved = F.transform(F.filter("epochs", lambda x: x["best"]), lambda x: x["epoch"])
    rows = log_runs(logs).withColumn("best", F.try_element_at(saved, F.lit(-1)))
    n = F.size("epochs")
    to_best = [F.when(F.col("best").isNotNull(), total(c, F.col("best"))) for c in ("seconds", "val_seconds")]
    out = rows.select(
        "log_id",
        "partition",
        "run",
        (total("seconds") / n).alias("avg_time_per_epoch"),
        F.col("best").alias("number_of_epoch_at_best_model"),
        n.alias("number_of_epoch_at_finish"),
        to_best[0].alias("total_train_time_at_best_model"),
        total("seconds").alias("total_train_time_at_finish"),
        to_best[1].alias("total_val_time_at_best_model"),
        total("val_seconds").alias("total_val_time_at_finish"),
        F.get("final.numbers", F.lit(0)).cast("double").alias("final_evaluation_time"),
    )
    return out.withColumn(
        "total_time_at_best_model", F.col("total_train_time_at_best_model") + F.col("total_val_time_at_best_model")
    ).withColumn("total_time_at_finish", F.col("total_train_time_at_finish") + F.col("total_val_time_at_finish"))
