"""Scores of binary classifiers as aggregations over (label, prediction, score) rows.

``by`` names grouping columns (model, fold, ...), so any number of models is scored
in one job. Curves group rows by score first; a score that many rows share is a
single point, and running totals over the points use the bucketed form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import col
from wardtable.operators.ordered import running
from wardtable.session import written

EPS = 1e-15


def _safe(a: Column, b: Column) -> Column:
    """Ratio with a zero denominator counted as 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _rows(condition: Column, times: str | None) -> Column:
    """Number of rows that meet a condition; ``times`` is a column with how often a row counts."""
    if times is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, col(times))), F.lit(0)).cast("bigint")


def confusion(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), times: str | None = None
) -> DataFrame:
    """Counts ``tn, fp, fn, tp``; absent cells are 0."""
    y, p = col(label).cast("int"), col(prediction).cast("int")
    return df.groupBy(*by).agg(
        _rows((y == 0) & (p == 0), times).alias("tn"),
        _rows((y == 0) & (p == 1), times).alias("fp"),
        _rows((y == 1) & (p == 0), times).alias("fn"),
        _rows((y == 1) & (p == 1), times).alias("tp"),
    )


def class_scores(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), times: str | None = None
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class."""
    tn, fp, fn, tp = (F.col(c) for c in ["tn", "fp", "fn", "tp"])
    return confusion(df, label, prediction, by, times).select(
        *by,
        _safe(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _safe(tp, tp + fp).alias("precision"),
        _safe(tp, tp + fn).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_points(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    buckets: int | None = None,
    times: str | None = None,
) -> DataFrame:
    """Per distinct score, high to low: own and running counts of positives and negatives."""
    y = col(label).cast("int")
    points = df.groupBy(*by, col(score).cast("double").alias("threshold")).agg(
        _rows(y == 1, times).alias("own_tp"), _rows(y == 0, times).alias("own_fp")
    )
    return running(
        points,
        "threshold",
        {"tp": ("sum", "own_tp"), "fp": ("sum", "own_fp")},
        by=by,
        descending=True,
        buckets=buckets,
    )


def _totals(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    y = col(label).cast("int")
    return df.groupBy(*by).agg(F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"))


def _with_totals(points: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return points.join(totals, list(by))
    return points.withColumn("_p", totals.select("_p").scalar()).withColumn("_n", totals.select("_n").scalar())


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score, plus the start at (0, 0)."""
    totals = _totals(df, label, by)
    points = _with_totals(score_points(df, label, score, by), totals, by)
    start = totals.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.select(
        *by,
        "threshold",
        _safe(F.col("fp"), F.col("_n")).alias("fpr"),
        _safe(F.col("tp"), F.col("_p")).alias("tpr"),
    ).unionByName(start)


def pr_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, plus the end at recall 0."""
    totals = _totals(df, label, by)
    points = _with_totals(score_points(df, label, score, by), totals, by)
    end = totals.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.select(
        *by,
        "threshold",
        _safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _safe(F.col("tp"), F.col("_p")).alias("recall"),
    ).unionByName(end)


def ranking_scores(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), times: str | None = None
) -> DataFrame:
    """Area under the ROC curve (ties exact) and average precision, one job for both.

    Each point adds its own trapezoid and its own recall step, so no row has to look
    at its neighbour. A class without rows gives null.
    """
    points = score_points(df, label, score, by, times=times)
    before = F.col("tp") - F.col("own_tp")
    trapezoid = F.col("own_fp").cast("double") * (before + F.col("own_tp") / 2.0)
    step = F.col("own_tp").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))
    p, n = F.sum("own_tp"), F.sum("own_fp")
    return points.groupBy(*by).agg(
        F.when((p > 0) & (n > 0), F.sum(trapezoid) / (p.cast("double") * n)).alias("roc_auc"),
        F.when(p > 0, F.sum(step) / p).alias("avg_precision"),
    )


def log_loss(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    from_labels: bool = False,
    times: str | None = None,
) -> DataFrame:
    """Mean negative log of the probability given to the true class.

    ``from_labels`` treats a hard 0/1 prediction as the probability.
    """
    s = col(score).cast("double")
    if from_labels:
        s = F.round(s)
    p = F.least(F.greatest(s, F.lit(EPS)), F.lit(1 - EPS))
    truth = F.when(col(label).cast("int") == 1, p).otherwise(1 - p)
    if times is None:
        return df.groupBy(*by).agg(F.avg(-F.log(truth)).alias("log_loss"))
    total = F.sum(-F.log(truth) * col(times)) / F.sum(col(times))
    return df.groupBy(*by).agg(total.alias("log_loss"))


def class_report(
    df: DataFrame, label: str, prediction: str, score: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Rows ``0, 1, accuracy, macro avg, weighted avg`` with their scores and support."""
    tn, fp, fn, tp = (F.col(c) for c in ["tn", "fp", "fn", "tp"])
    n0, n1 = tn + fp, tp + fn
    total = n0 + n1

    def prf(hit, predicted, actual):
        return _safe(hit, predicted), _safe(hit, actual), _safe(2 * hit, predicted + actual)

    zero, one = prf(tn, tn + fn, n0), prf(tp, tp + fp, n1)
    accuracy = _safe(tp + tn, total)

    def line(name, p, r, f, support):
        return F.struct(
            F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
            support.cast("double").alias("support"),
        )

    lines = [
        line("0", *zero, n0),
        line("1", *one, n1),
        line("accuracy", accuracy, accuracy, accuracy, accuracy),
        line("macro avg", *[(a + b) / 2 for a, b in zip(zero, one)], total),
        line("weighted avg", *[_safe(a * n0 + b * n1, total) for a, b in zip(zero, one)], total),
    ]
    report = confusion(df, label, prediction, by).select(*by, F.inline(F.array(*lines)))
    if score is None:
        return report
    auc = ranking_scores(df, label, score, by).select(*by, "roc_auc")
    if by:
        return report.join(auc, list(by), "left")
    return report.withColumn("roc_auc", auc.scalar().cast("double"))


def compare_models(
    df: DataFrame, label: str, prediction: str, score: str, by: Sequence[str] = ("model",)
) -> DataFrame:
    """One row per model: F1, recall, accuracy, precision, area, log-loss.

    Models whose rows have no score keep a null area and log-loss. The rows, which models score as they are read, are read once.
    """
    # One row per distinct score, prediction and label; all measures follow from these counts.
    points = df.groupBy(
        *by, col(label).alias("_y"), col(prediction).alias("_p"), col(score).cast("double").alias("_s")
    ).agg(F.count(F.lit(1)).alias("_times"))
    points = written(points, "points")
    hard = class_scores(points, "_y", "_p", by, "_times")
    scored = points.filter(F.col("_s").isNotNull())
    areas = ranking_scores(scored, "_y", "_s", by, "_times").select(*by, "roc_auc")
    loss = log_loss(scored, "_y", "_s", by, times="_times")
    return hard.join(areas, list(by), "left").join(loss, list(by), "left")
