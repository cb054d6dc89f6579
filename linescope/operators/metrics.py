"""Classification metrics from a confusion table.

Predictions are counted once per (true, predicted) pair; everything else runs on those few rows.
``by`` columns evaluate many prediction sets in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.functions.vectors import argmax

REPORT_DIGITS = 3


def confusion(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """(by, true, pred, n)."""
    return df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, tp, n_true, n_pred) over the union of true and predicted classes."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("true").alias("class"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")),
    )
    rows = table.select(*by, F.inline(sides))
    return rows.groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def scores(classes: DataFrame, by: Sequence[str] = (), positive: object = 1) -> DataFrame:
    """One row per ``by`` group with accuracy, averaged precision/recall/F1 and the correlation.

    Averages: ``macro_*`` over the union of classes, ``weighted_*`` by true rows, ``binary_*`` of
    the ``positive`` class. An undefined ratio counts as 0.
    """
    tp, t, p = (F.col(c).cast("double") for c in ("tp", "n_true", "n_pred"))
    rows = classes.select(
        *by,
        "class",
        tp.alias("tp"),
        t.alias("t"),
        p.alias("p"),
        _ratio(tp, p).alias("precision"),
        _ratio(tp, t).alias("recall"),
        _ratio(2.0 * tp, p + t).alias("f1"),
    )
    names = ["precision", "recall", "f1"]
    aggs = [
        F.sum("tp").alias("_c"),
        F.sum("t").alias("_s"),
        F.sum(F.col("p") * F.col("t")).alias("_pt"),
        F.sum(F.col("p") * F.col("p")).alias("_pp"),
        F.sum(F.col("t") * F.col("t")).alias("_tt"),
        F.sum((F.col("t") > 0).cast("int")).alias("true_classes"),
    ]
    aggs += [F.avg(x).alias(f"macro_{x}") for x in names]
    aggs += [F.sum(F.col(x) * F.col("t")).alias(f"_w_{x}") for x in names]
    aggs += [F.coalesce(F.max(F.when(F.col("class") == positive, F.col(x))), F.lit(0.0)).alias(f"binary_{x}") for x in names]
    out = rows.groupBy(*by).agg(*aggs)
    s = F.col("_s")
    spread = F.sqrt((s * s - F.col("_pp")) * (s * s - F.col("_tt")))
    out = out.withColumn("accuracy", F.col("_c") / s).withColumn("mcc", _ratio(F.col("_c") * s - F.col("_pt"), spread))
    for x in names:
        out = out.withColumn(f"weighted_{x}", F.col(f"_w_{x}") / s)
    return out.drop("_c", "_s", "_pt", "_pp", "_tt", *[f"_w_{x}" for x in names])


def report(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: Sequence[str] = (), digits: int | None = REPORT_DIGITS) -> DataFrame:
    """(by, acc, prec, rec, gmean, f1, mcc), macro averages.

    With one true class precision, recall and F1 are the accuracy.
    """
    rows = scores(class_counts(confusion(df, true, pred, by), by), by)
    single = F.col("true_classes") == 1

    def pick(name: str) -> Column:
        return F.when(single, F.col("accuracy")).otherwise(F.col(f"macro_{name}"))

    columns = {
        "acc": F.col("accuracy"),
        "prec": pick("precision"),
        "rec": pick("recall"),
        "gmean": F.sqrt(pick("recall") * pick("precision")),
        "f1": pick("f1"),
        "mcc": F.col("mcc"),
    }
    return rows.select(*by, *[(F.round(c, digits) if digits is not None else c).alias(n) for n, c in columns.items()])


def validation_report(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """(by, acc, precision, recall, f1, mcc): macro averages without rounding."""
    rows = scores(class_counts(confusion(df, true, pred, by), by), by)
    return rows.select(
        *by,
        F.col("accuracy").alias("acc"),
        F.col("macro_precision").alias("precision"),
        F.col("macro_recall").alias("recall"),
        F.col("macro_f1").alias("f1"),
        "mcc",
    )


def averaged_report(
    df: DataFrame, true: str = "y_true", pred: str = "y_pred", binary: bool = True, by: Sequence[str] = (), positive: object = 1
) -> DataFrame:
    """Accuracy, averaged precision/recall, micro/macro/averaged F1, gmean and correlation."""
    kind = "binary" if binary else "weighted"
    rows = scores(class_counts(confusion(df, true, pred, by), by), by, positive)
    return rows.select(
        *by,
        F.col("accuracy").alias("acc"),
        F.col(f"{kind}_precision").alias("precision"),
        F.col(f"{kind}_recall").alias("recall"),
        F.col("accuracy").alias("f1_micro"),
        F.col("macro_f1").alias("f1_macro"),
        F.col(f"{kind}_f1").alias("f1"),
        F.sqrt(F.col(f"{kind}_recall") * F.col(f"{kind}_precision")).alias("gmean"),
        "mcc",
    )


def logits_report(df: DataFrame, logits: str, true: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, macro_f1, mcc) of the first largest logit."""
    rows = df.withColumn("_pred", argmax(F.col(logits)))
    out = scores(class_counts(confusion(rows, true, "_pred", by), by), by)
    return out.select(*by, "macro_f1", "mcc")
