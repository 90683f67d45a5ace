"""Long to wide and back: pivots, one-hot columns, exploded lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import col
from wardtable.operators.joins import balanced_join

MAX_LEVELS = 5_000


def level_values(df: DataFrame, column: str, cap: int = MAX_LEVELS) -> list:
    """Distinct values of a column, sorted; fails (never truncates) beyond ``cap``."""
    rows = df.select(col(column)).filter(col(column).isNotNull()).distinct().limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"{column} has more than {cap} distinct values: not a pivot column")
    return sorted(r[0] for r in rows)


def pivot_sum(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    value: Column,
    values: Sequence | None = None,
    prefix: str = "",
) -> DataFrame:
    """Rows of an item table to one column per item: the sum of ``value``, 0 if absent.

    Rows with a missing key or item are left out. With ``values`` the schema is known
    and there is a single job; otherwise one distinct job finds them. The sums are
    conditional aggregates in one ``groupBy``, so a key that owns a large share of
    the rows shrinks to one row per task before the only shuffle.
    """
    keys = list(keys)
    if values is None:
        values = level_values(df, column)
    present = col(column).isNotNull()
    for k in keys:
        present = present & col(k).isNotNull()
    item = col(column)
    cells = [
        F.coalesce(F.sum(F.when(item == F.lit(v), value)), F.lit(0)).alias(f"{prefix}{v}")
        for v in values
    ]
    rows = df.filter(present)
    if not cells:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*cells)


def pivot_count(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    values: Sequence | None = None,
    prefix: str = "",
) -> DataFrame:
    """Occurrences of each item per key, 0 if absent."""
    return pivot_sum(df, keys, column, F.lit(1), values, prefix)


def one_hot(
    df: DataFrame, columns: Sequence[str], values: dict[str, Sequence] | None = None
) -> DataFrame:
    """Boolean column ``{column}_{value}`` per level; a missing value is false everywhere."""
    values = dict(values or {})
    for c in columns:
        if c not in values:
            values[c] = level_values(df, c)
    dummies = [
        F.coalesce(col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
        for c in columns
        for v in values[c]
    ]
    return df.select(*[col(c) for c in df.columns if c not in columns], *dummies)


def explode_list(df: DataFrame, column: str) -> DataFrame:
    """One row per list element; a missing or empty list keeps one row with null."""
    return df.withColumn(column, F.explode_outer(col(column)))


def row_weight(
    df: DataFrame, person: str, weight: str = "weight", shared: str = "co_infection"
) -> DataFrame:
    """``1 / rows of the person`` and a flag for persons with more than one row.

    Counted with a pre-aggregating ``groupBy`` and joined back, not with a window: a
    window would bring all rows of one person into one task. The join spreads such persons.
    """
    counts = df.groupBy(person).agg(F.count(F.lit(1)).alias("_rows"))
    return (
        balanced_join(df, counts, [person], right_unique=True)
        .withColumn(weight, F.lit(1.0) / F.col("_rows"))
        .withColumn(shared, F.when(F.col(weight) < 1, 1).otherwise(0))
        .drop("_rows")
    )
