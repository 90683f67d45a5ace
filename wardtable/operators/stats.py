"""Summaries of tables and columns, each one or two aggregate passes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardtable.functions.tables import literal_table
from wardtable.functions.expressions import col, days_between, known
from wardtable.operators.columns import columns_of, is_missing
from wardtable.operators.gram import pair_moments
from wardtable.operators.ordered import average_ranks
from wardtable.operators.quantiles import exact_quantiles
from wardtable.session import new_folder

# --- per key ----------------------------------------------------------------


def any_positive(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """True per key if any value is above 0; missing values do not count."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.bool_or(known(col(column)) > 0), F.lit(False)).alias(out)
    )


def distinct_per_key(
    df: DataFrame, keys: Sequence[str], column: str, out: str, approximate: bool = False
) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*keys).agg(count(col(column)).alias(out))


def latest_per_key(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(col(column)).alias(out))


def mean_gap(df: DataFrame, keys: Sequence[str], date: str, out: str) -> DataFrame:
    """Mean days between successive distinct dates of a key; null for a single date.

    Successive gaps add up to ``last - first``, so three mergeable aggregates replace
    an ordered window over all rows of the key.
    """
    day = col(date).cast("date")
    return (
        df.groupBy(*keys)
        .agg(F.min(day).alias("_a"), F.max(day).alias("_b"), F.count_distinct(day).alias("_n"))
        .select(
            *keys,
            F.when(F.col("_n") > 1, days_between(F.col("_b"), F.col("_a")) / (F.col("_n") - 1)).alias(out),
        )
    )


# --- whole table ------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequencies of the values present, most frequent first."""
    return (
        df.filter(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value"))
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with their count."""
    return (
        df.groupBy(*[col(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def outlier_limits(
    df: DataFrame, columns: Sequence[str], k: float = 3.0
) -> dict[str, tuple[float, float]]:
    """``Q1 - k*IQR`` and ``Q3 + k*IQR`` for all columns together."""
    limits = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            limits[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return limits


def _outside(c: Column, limits: tuple[float, float]) -> Column:
    return (c < F.lit(limits[0])) | (c > F.lit(limits[1]))


def outlier_report(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Count of outliers per column with the limits used."""
    names = list(limits)
    counted = df.agg(
        *[F.count_if(_outside(col(c), limits[c])).alias(f"n{i}") for i, c in enumerate(names)]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(limits[c][0]).alias("lower_limit"),
                F.lit(limits[c][1]).alias("upper_limit"),
                F.col(f"n{i}").cast("bigint").alias("n_outliers"),
            )
            for i, c in enumerate(names)
        ]
    )
    return counted.select(F.inline(cells))


def outlier_rows(df: DataFrame, column: str, limits: tuple[float, float]) -> DataFrame:
    return df.filter(_outside(col(column), limits))


def clean_outliers(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Outliers become missing."""
    return df.select(
        *[
            F.when(~_outside(col(c), limits[c]), col(c)).alias(c) if c in limits else col(c)
            for c in df.columns
        ]
    )


def interval_labels(value: Column, edges: Sequence[float]) -> Column:
    """0-based label of right-closed intervals; the smallest edge belongs to label 0.

    ``edges`` includes both ends. Tied edges collapse, so the label is the number of
    distinct inner edges below the value.
    """
    inner = sorted(set(edges))[1:-1]
    out = F.lit(0)
    for e in inner:
        out = out + F.when(value > F.lit(e), 1).otherwise(0)
    return F.when(value.isNotNull(), out)


def quantile_recode(
    df: DataFrame,
    columns: Sequence[str],
    q: int = 4,
    suffix: str = "_recoded",
    on_ties: str = "collapse",
) -> DataFrame:
    """``{column}{suffix}`` with labels 0..q-1 by interpolated quantiles.

    Unlike ``ntile`` equal values always share a label. ``on_ties="error"`` fails when
    quantiles coincide instead of collapsing them.
    """
    shares = [i / q for i in range(q + 1)]
    found = exact_quantiles(df, columns, shares)
    return df.select("*", *_labels(found, suffix, on_ties))


def _labels(found: dict[str, list], suffix: str, on_ties: str) -> list[Column]:
    labels = []
    for c, edges in found.items():
        if edges[0] is None:
            labels.append(F.lit(None).cast("int").alias(c + suffix))
            continue
        if on_ties == "error" and len(set(edges)) < len(edges):
            raise ValueError(f"quantiles of {c} coincide: {edges}")
        labels.append(interval_labels(col(c), edges).alias(c + suffix))
    return labels


def outliers_and_quartiles(
    df: DataFrame, columns: Sequence[str], k: float = 3.0, on_ties: str = "collapse"
) -> DataFrame:
    """Null outliers beyond ``k`` interquartile ranges, then add quartile labels.

    Columns that do not exist are skipped. The table is read several times and therefore written once.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    path = new_folder(df.sparkSession, "measured")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    limits = outlier_limits(df, present, k)
    edges = exact_quantiles(clean_outliers(df, limits), present, [0, 0.25, 0.5, 0.75, 1])
    return clean_outliers(df, limits).select("*", *_labels(edges, "_recoded", on_ties))


# --- profile ----------------------------------------------------------------


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, missing, distinct, range, mean, deviation, top value.

    Two jobs' worth of work in one plan: plain aggregates for the numbers, and value
    frequencies over (column, value) pairs, which combine before the shuffle.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    numbers = {f.name for f in fields if isinstance(f.dataType, T.NumericType)}

    def aggs(i: int, f: T.StructField) -> list[Column]:
        c = col(f.name)
        present = F.when(~is_missing(f), c)
        double = present.cast("double") if f.name in numbers else F.lit(None).cast("double")
        return [
            F.count_if(is_missing(f)).alias(f"m{i}"),
            F.min(double).alias(f"lo{i}"),
            F.max(double).alias(f"hi{i}"),
            F.avg(double).alias(f"a{i}"),
            F.stddev_samp(double).alias(f"s{i}"),
        ]

    summed = df.agg(
        F.count(F.lit(1)).alias("n"), *[a for i, f in enumerate(fields) for a in aggs(i, f)]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("n").cast("bigint").alias("n"),
                F.col(f"m{i}").cast("bigint").alias("n_missing"),
                F.col(f"lo{i}").alias("min"),
                F.col(f"hi{i}").alias("max"),
                F.col(f"a{i}").alias("mean"),
                F.col(f"s{i}").alias("std"),
            )
            for i, f in enumerate(fields)
        ]
    )
    summary = summed.select(F.inline(cells))
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.when(~is_missing(f), col(f.name)).cast("string").alias("value"),
                )
                for f in fields
            ]
        )
    )
    frequencies = (
        df.select(pairs.alias("p"))
        .select("p.column", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    top = (
        frequencies.groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n_distinct"),
            F.min(F.struct((-F.col("freq")).alias("f"), F.col("value"))).alias("t"),
        )
        .select(
            "column",
            "n_distinct",
            F.col("t.value").alias("top"),
            (-F.col("t.f")).alias("top_freq"),
        )
    )
    return summary.join(top, "column", "left").fillna(0, ["n_distinct"])


def profile_quantiles(df: DataFrame, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Quantiles of every number column as ``(column, share, value)``."""
    found = exact_quantiles(df, columns_of(df, "number"), shares)
    rows = [(c, float(s), v) for c, vs in found.items() for s, v in zip(shares, vs)]
    return literal_table(df.sparkSession, rows, "column string, share double, value double")


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation of every column pair (i < j) as ``(column_a, column_b, r)``, over the rows that have both values.

    One scan gives the moments of all pairs (see ``gram``). Spearman is the same over the columns' average
    ranks, each among all values of its column (see ``ordered.average_ranks``). A column
    that is constant over a pair's rows has no correlation. Nothing passes through the driver.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"no correlation method {method}: pearson, spearman")
    columns = list(columns)
    last = len(columns) - 1
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    every = df.sparkSession.range(0, max(last, 0), 1, 1).select(
        F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.col("id").cast("int") + 1, F.lit(last))).alias("j")
    )
    if last < 1:
        found = every.withColumn("r", F.lit(None).cast("double"))
    else:
        if method == "pearson":
            moments = pair_moments(df, [col(c) for c in columns])
        else:
            moments = pair_moments(average_ranks(df, columns), [F.get("ranks", F.lit(k)) for k in range(last + 1)])
        spread = F.nullif(F.sqrt("squares_i") * F.sqrt("squares_j"), F.lit(0.0))
        found = moments.select("i", "j", (F.col("products") / spread).alias("r"))
    return every.join(found, ["i", "j"], "left").select(
        F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), known(F.col("r")).alias("r")
    )


def drop_correlated(
    df: DataFrame, threshold: float, columns: Sequence[str] | None = None, method: str = "pearson"
) -> tuple[DataFrame, DataFrame]:
    """Drop the later column of every pair whose absolute correlation is above ``threshold``.

    A column already dropped drops no other. Returns the table and the pairs acted on.
    """
    columns = list(columns or columns_of(df, "number"))
    found = {
        (r["column_a"], r["column_b"]): r["r"] for r in correlations(df, columns, method).collect()
    }  # one row per column pair
    gone: list[str] = []
    report = []
    for a, b in combinations(columns, 2):
        r = found[(a, b)]
        if a not in gone and b not in gone and r is not None and abs(r) > threshold:
            gone.append(b)
            report.append((a, b, r))
    schema = "kept string, dropped string, r double"
    return df.drop(*gone), literal_table(df.sparkSession, report, schema)


# --- tables behind charts ---------------------------------------------------


def _bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column, missing ones left out; 0 and 0 without a value."""
    row = df.agg(
        *[F.min(known(col(c).cast("double"))).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(known(col(c).cast("double"))).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0) for i, c in enumerate(columns)}


def bin_of(c: Column, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin, missing values to none."""
    c = known(c)
    if not high > low:
        return F.when(c.isNotNull(), F.lit(0))
    place = F.floor((c.cast("double") - F.lit(low)) / F.lit((high - low) / bins))
    return F.least(place, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin (and class); empty bins are left out."""
    low, high = _bounds(df, [column])[column]
    width = (high - low) / bins
    return (
        df.filter(known(col(column)).isNotNull())
        .groupBy(*by, bin_of(col(column), low, high, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("left", F.lit(low) + F.col("bin") * F.lit(width))
        .withColumn("right", F.lit(low) + (F.col("bin") + 1) * F.lit(width))
    )


def pair_means(
    df: DataFrame, columns: Sequence[str], hue: str, pairs: Iterable[tuple[str, str]] | None = None
) -> DataFrame:
    """Mean, deviation and count of y per level of x and class, every ordered pair in one pass."""
    pairs = list(pairs or permutations(columns, 2))
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(x).alias("x"),
                    F.lit(y).alias("y"),
                    col(x).cast("double").alias("level"),
                    col(y).cast("double").alias("v"),
                )
                for x, y in pairs
            ]
        )
    )
    return (
        df.select(col(hue).alias("hue"), cells.alias("c"))
        .select("hue", "c.*")
        .groupBy("x", "y", "level", "hue")
        .agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"))
    )


def pair_bins(
    df: DataFrame,
    columns: Sequence[str],
    hue: str,
    bins: int = 20,
    pairs: Iterable[tuple[str, str]] | None = None,
) -> DataFrame:
    """Two-dimensional binned counts per class: the point cloud without its points."""
    pairs = list(pairs or combinations(columns, 2))
    used = list(dict.fromkeys(c for p in pairs for c in p))
    bounds = _bounds(df, used)
    binned = df.select(
        col(hue).alias("hue"),
        *[bin_of(col(c), *bounds[c], bins).alias(f"b{i}") for i, c in enumerate(used)],
    )
    at = {c: f"b{i}" for i, c in enumerate(used)}
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(x).alias("x"),
                    F.lit(y).alias("y"),
                    F.col(at[x]).alias("x_bin"),
                    F.col(at[y]).alias("y_bin"),
                )
                for x, y in pairs
            ]
        )
    )
    return (
        binned.select("hue", cells.alias("c"))
        .select("hue", "c.*")
        .filter(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
        .groupBy("x", "y", "x_bin", "y_bin", "hue")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def density(
    df: DataFrame, column: str, bins: int = 200, grid: int = 100, bandwidth: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Gaussian kernel density on a grid, from bin counts instead of raw rows.

    Rows are binned first; each of the few bins then spreads its weight over the
    grid. The default bandwidth is Scott's rule on the whole column.
    """
    low, high = _bounds(df, [column])[column]
    value = known(col(column).cast("double"))
    row = df.agg(F.stddev_samp(value).alias("s"), F.count(value).alias("n")).first()
    if bandwidth is None:
        bandwidth = (row["s"] or 1.0) * max(row["n"], 1) ** (-1 / 5)
    width = (high - low) / bins
    step = (high - low) / (grid - 1)
    counts = histogram(df, column, bins, by)
    centre = F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)
    point = F.lit(low) + F.col("i") * F.lit(step)
    z = (point - centre) / F.lit(bandwidth)
    kernel = F.exp(-0.5 * z * z) / F.lit(bandwidth * math.sqrt(2 * math.pi))
    summed = (
        counts.select(*by, "bin", "n", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
        .groupBy(*by, "i")
        .agg(F.sum(F.col("n") * kernel).alias("_k"), F.sum("n").alias("_n"))
    )
    return summed.select(*by, "i", point.alias("x"), (F.col("_k") / F.col("_n")).alias("density"))
