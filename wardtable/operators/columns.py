"""Column management: names, fills, filters and one-pass column statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardtable.functions.tables import literal_table
from wardtable.functions.expressions import col, known, row_sum

# Identifiers and leak columns removed before modelling.
NON_FEATURES = [
    "Unnamed: 0", "person_id", "fecha_ingreso_urgencias", "shock_septico", "foco",
    "sintoma_nan", "fecha_nacimiento", "codigo_postal", "center", "dag",
]

_KINDS = {
    "number": T.NumericType,
    "text": T.StringType,
    "boolean": T.BooleanType,
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


# --- names ------------------------------------------------------------------


def columns_like(df: DataFrame, text: str) -> list[str]:
    """Columns whose name contains ``text``."""
    return [c for c in df.columns if text in c]


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Columns of one kind: number, text, boolean or date."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _KINDS[kind])]


def other_columns(df: DataFrame, keys: Iterable[str]) -> list[str]:
    keys = set(keys)
    return [c for c in df.columns if c not in keys]


def added_columns(before: Iterable[str], after: DataFrame) -> list[str]:
    """Columns that a later step brought in."""
    return other_columns(after, before)


def merged_names(*lists: Iterable[str]) -> list[str]:
    """Union of name lists, sorted, without repeats."""
    return sorted({n for names in lists for n in names})


def drop_columns(df: DataFrame, names: Iterable[str], strict: bool = False) -> DataFrame:
    """Drop by name; ``strict`` fails on names that do not exist."""
    names = list(names)
    absent = [n for n in names if n not in df.columns]
    if strict and absent:
        raise KeyError(f"columns not found: {absent}")
    return df.drop(*names)


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[col(n) for n in names])


def prefix_columns(df: DataFrame, prefix: str, keys: Iterable[str]) -> DataFrame:
    keys = set(keys)
    return df.select(*[col(c).alias(c if c in keys else prefix + c) for c in df.columns])


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by dictionary; names that do not exist are ignored."""
    return df.select(*[col(c).alias(names.get(c, c)) for c in df.columns])


def names_from_codes(
    code_names: Iterable[dict[str, str]], pattern: str, replacement: str
) -> dict[str, str]:
    """Rename map from ``[{"value", "name"}]``: names stripped, blanks to underscores."""
    return {
        pattern.format(d["value"]): replacement.format(d["name"].strip().replace(" ", "_"))
        for d in code_names
    }


# --- cells ------------------------------------------------------------------


def fill_missing(df: DataFrame, value, only: Iterable[str] | None = None) -> DataFrame:
    """Fill missing cells according to each column's own type.

    ``False`` or 0 fill numbers with 0, booleans with false and text with the
    value's text. Dates and nested columns stay missing: a column has one type.
    """
    only = set(df.columns if only is None else only)
    filled = {}
    for f in df.schema.fields:
        if f.name not in only:
            continue
        c = col(f.name)
        if isinstance(f.dataType, T.NumericType):
            number = int(value) if isinstance(value, bool) else value
            if not isinstance(number, str):
                filled[f.name] = F.when(is_missing(f), F.lit(number).cast(f.dataType)).otherwise(c)
        elif isinstance(f.dataType, T.BooleanType):
            filled[f.name] = F.coalesce(c, F.lit(bool(value)))
        elif isinstance(f.dataType, T.StringType):
            filled[f.name] = F.coalesce(c, F.lit(str(value)))
    return df.withColumns(filled) if filled else df


def combine_columns(df: DataFrame, names: Sequence[str], new_name: str) -> DataFrame:
    """One whole-number column from a column family; the parts are dropped."""
    names = list(names)
    kept = [col(c) for c in df.columns if c not in names and c != new_name]
    numbers = [F.coalesce(known(col(n).cast("double")), F.lit(0.0)) for n in names]
    total: Column = F.lit(0.0)
    for n in numbers:
        total = total + n
    return df.select(*kept, total.cast("int").alias(new_name))


def sum_by_name(df: DataFrame, names: Iterable[str], suffix: str = "_total") -> DataFrame:
    """For each name, the row total over every column whose name contains it."""
    numeric = set(columns_of(df, "number"))
    totals = []
    for n in sorted(set(names)):
        parts = [c for c in df.columns if n in c and c in numeric]
        totals.append(row_sum(parts).alias(n + suffix))
    return df.select("*", *totals)


def split_label(df: DataFrame, label: str) -> tuple[list[str], DataFrame]:
    """Feature names and the table with its label as integer (same row, no index)."""
    features = other_columns(df, [label])
    return features, df.select(*[col(f) for f in features], col(label).cast("int").alias(label))


# --- rows -------------------------------------------------------------------


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    condition = F.lit(True)
    for f in df.schema.fields:
        condition = condition & ~is_missing(f)
    return df.filter(condition)


def is_missing(field: T.StructField) -> Column:
    c = col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_report(df: DataFrame) -> DataFrame:
    """One row per column: missing cells and their share in percent. One pass."""
    fields = df.schema.fields
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(f)).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(f.name).alias("column"), F.col(f"m{i}").alias("n_missing"))
                for i, f in enumerate(fields)
            ]
        )
    )
    return counted.select("n", cells.alias("c")).select(
        F.col("c.column").alias("column"),
        F.col("c.n_missing").cast("bigint").alias("n_missing"),
        F.try_divide(F.col("c.n_missing") * 100.0, F.col("n")).alias("pct"),
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """The table as missing/present marks (the matrix behind the null report)."""
    return df.select(*[is_missing(f).alias(f.name) for f in df.schema.fields])


def sparse_subset(df: DataFrame, pct: float = 30.0) -> DataFrame:
    """Only the columns whose missing share is above ``pct`` percent."""
    rows = null_report(df).filter(F.col("pct") > pct).select("column").collect()  # one per column
    wanted = {r["column"] for r in rows}
    return df.select(*[col(c) for c in df.columns if c in wanted])


def drop_sparse_columns(df: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Drop columns whose missing share is strictly above ``limit``.

    Shares are taken over the rows at entry, all columns in one pass. Returns the
    table and a report ``(column, share, dropped)``.
    """
    fields = df.schema.fields
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~is_missing(f)).alias(f"p{i}") for i, f in enumerate(fields)],
    ).first()
    n = row["n"]
    report = []
    for i, f in enumerate(fields):
        share = 1 - row[f"p{i}"] / n if n else 0.0
        report.append((f.name, float(share), share > limit))
    kept = [col(name) for name, _, gone in report if not gone]
    schema = "column string, share double, dropped boolean"
    return df.select(*kept), literal_table(df.sparkSession, report, schema)


def drop_low_variance(df: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Drop numeric columns whose sample variance is at or below ``threshold``."""
    numeric = columns_of(df, "number")
    if not numeric:
        return df, literal_table(df.sparkSession, [], "column string, variance double, dropped boolean")
    row = df.agg(*[F.var_samp(known(col(c))).alias(f"v{i}") for i, c in enumerate(numeric)]).first()
    report = []
    for i, c in enumerate(numeric):
        v = row[f"v{i}"]
        report.append((c, v, v is not None and v <= threshold))
    gone = [c for c, _, d in report if d]
    schema = "column string, variance double, dropped boolean"
    return df.drop(*gone), literal_table(df.sparkSession, report, schema)


def classify_columns(
    df: DataFrame, max_levels: int = 15, exclude: Iterable[str] = ()
) -> dict[str, list[str]]:
    """Split columns into binary, few-level, continuous and text ones.

    First pass: off-0/1 marks and a distinct-count sketch for every number column.
    Only columns whose sketch is anywhere near ``max_levels`` are counted exactly, in
    one job over (column, value) pairs, which pre-aggregates to a handful of rows.
    """
    exclude = set(exclude)
    numeric = [c for c in columns_of(df, "number") if c not in exclude]
    text = [c for c in columns_of(df, "text") if c not in exclude]
    groups = {"binary": [], "levels": [], "continuous": [], "text": text}
    if not numeric:
        return groups
    aggs = []
    for i, c in enumerate(numeric):
        aggs.append(F.coalesce(F.bool_or(~known(col(c)).isin(0, 1)), F.lit(False)).alias(f"off{i}"))
        aggs.append(F.approx_count_distinct(known(col(c))).alias(f"d{i}"))
    row = df.agg(*aggs).first()
    unsure = []
    for i, c in enumerate(numeric):
        if not row[f"off{i}"]:
            groups["binary"].append(c)
        elif row[f"d{i}"] > max_levels * 4:
            groups["continuous"].append(c)
        else:
            unsure.append(c)
    if unsure:
        pairs = F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("name"), col(c).cast("double").alias("value")) for c in unsure]
            )
        )
        counts = (
            df.select(pairs.alias("p"))
            .select("p.name", "p.value")
            .filter(known(F.col("value")).isNotNull())
            .distinct()
            .groupBy("name")
            .count()
            .collect()  # one row per column
        )
        levels = {r["name"]: r["count"] for r in counts}
        for c in unsure:
            groups["levels" if levels.get(c, 0) < max_levels else "continuous"].append(c)
    order = {c: i for i, c in enumerate(df.columns)}
    for g in groups.values():
        g.sort(key=order.__getitem__)
    return groups


def plot_groups(df: DataFrame, family: str, max_levels: int = 15) -> dict[str, list[str]]:
    """Columns for pair grids: a name family, the binary rest and the numeric rest."""
    named = columns_like(df, family)
    kinds = classify_columns(df, max_levels, exclude=named)
    return {
        "family": named,
        "binary": kinds["binary"],
        "numeric": [c for c in df.columns if c in kinds["levels"] + kinds["continuous"]],
    }
