"""Choosing among results: Pareto front, best so far, best row, common features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import col
from wardtable.operators.ordered import running


def pareto_front(df: DataFrame, maximize: str, minimize: str) -> DataFrame:
    """Rows no other row beats in both objectives (equal rows all stay).

    Best second objective per first objective, then one running minimum from the best
    first objective down: sorted work instead of comparing every pair of rows.
    """
    best = df.groupBy(col(maximize).cast("double").alias("_a")).agg(
        F.min(col(minimize).cast("double")).alias("_b")
    )
    best = best.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    ahead = running(best, "_a", {"_best": ("min", "_b")}, descending=True, exclusive=True)
    front = ahead.filter(F.col("_best").isNull() | (F.col("_b") < F.col("_best"))).select("_a", "_b")
    return (
        df.withColumn("_a", col(maximize).cast("double"))
        .withColumn("_b", col(minimize).cast("double"))
        .join(front, ["_a", "_b"], "left_semi")
        .drop("_a", "_b")
    )


def first_of_front(df: DataFrame, maximize: str, minimize: str, trial: str) -> DataFrame:
    """The front's row with the lowest trial number."""
    return pareto_front(df, maximize, minimize).orderBy(F.asc(trial)).limit(1)


def best_so_far(
    df: DataFrame, trial: str, value: str, by: Sequence[str] = (), largest: bool = True
) -> DataFrame:
    """Running best of ``value`` along a unique trial number, per model."""
    rows = df.filter(col(value).isNotNull())
    return running(rows, trial, {"best": ("max" if largest else "min", value)}, by=by)


def arg_max(df: DataFrame, score: str, tie: str) -> DataFrame:
    """The row with the best score, the smallest ``tie`` value among equals."""
    return df.orderBy(F.desc_nulls_last(score), F.asc(tie)).limit(1)


def ranked_features(df: DataFrame, importance: str = "importance", feature: str = "feature") -> DataFrame:
    return df.orderBy(F.desc(importance), F.desc(feature))


def consensus(df: DataFrame, item: str, source: str) -> DataFrame:
    """Items that occur in every source (the intersection of all sets)."""
    sources = df.select(source).distinct().count()
    return (
        df.filter(col(item).isNotNull())
        .groupBy(item)
        .agg(F.count_distinct(col(source)).alias("_n"))
        .filter(F.col("_n") == sources)
        .select(item)
    )
