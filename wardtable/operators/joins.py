"""Joins of form tables and dictionary lookups.

All joins are plain ones: adaptive execution broadcasts a side once its size is known to be
small, and splits a key that holds a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.functions.tables import literal_table
from wardtable.functions.expressions import col, normalise_code
from wardtable.operators.columns import fill_missing, other_columns

# --- joins ------------------------------------------------------------------


def balanced_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", right_unique: bool = False
) -> DataFrame:
    """Left or inner key join that stays even when one key owns a large share of either side.

    Adaptive execution splits a large partition of either side of an inner join, and of the left side of a
    left join. A left join with a right side that repeats keys is therefore written as the inner join and the left rows
    without a match, so every side that can be hot can be split. Nothing runs while the plan is written, no key is
    listed, and rows with equal values or null keys are split like all others.
    """
    keys = list(keys)
    if how == "inner" or right_unique:
        return left.join(right, keys, how)
    if how != "left":
        raise ValueError(f"balanced_join is for left and inner joins, not {how}")
    alone = left.join(right.select(*[col(k) for k in keys]).distinct(), keys, "left_anti")
    return left.join(right, keys, "inner").unionByName(alone, allowMissingColumns=True)


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column the two tables share."""
    shared = sorted(set(left.columns) & set(right.columns))
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, "left")


def join_with_suffixes(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_keys_match: bool = False,
    balance: bool = False,
) -> DataFrame:
    """Key join; other columns that exist on both sides get the suffixes.

    ``balance`` spreads keys that own a large share of the rows (see ``balanced_join``).
    """
    keys = list(keys)
    both = (set(left.columns) & set(right.columns)) - set(keys)
    a, b = (
        # Only tables with a collision need another projection: wide plans are slow to analyse.
        side.withColumnsRenamed({c: c + suffix for c in both}) if both else side
        for side, suffix in zip((left, right), suffixes)
    )
    if not null_keys_match:
        return balanced_join(a, b, keys, how) if balance else a.join(b, keys, how)
    renamed = b.select(*[col(c).alias(f"_k_{c}" if c in keys else c) for c in b.columns])
    condition = reduce(lambda x, y: x & y, [a[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return a.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def join_forms(
    base: DataFrame, forms: Iterable[DataFrame], keys: Sequence[str], balance: bool = False
) -> DataFrame:
    """Chain of left joins on the same keys: every step reuses the base partitioning.

    Joins on the person alone should ``balance``: one person may own many rows, while
    person and admission together spread well.
    """
    return reduce(lambda a, b: join_with_suffixes(a, b, keys, balance=balance), forms, base)


def join_person(
    left: DataFrame,
    right: DataFrame,
    person: str,
    admission: str,
    on_admission: bool = True,
    how: str = "left",
) -> DataFrame:
    """Join an admission-level table to another one, on both keys.

    ``on_admission=False`` joins on the person only and keeps the left admission, so a person with
    several admissions on both sides gets every combination (as analysts of the original tables expect).
    """
    if on_admission and admission in right.columns:
        return join_with_suffixes(left, right, [person, admission], how)
    return join_with_suffixes(left, right.drop(admission), [person], how, balance=True)


def join_zero_filled(
    left: DataFrame, rights: Iterable[DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Left joins whose new number columns are 0 instead of missing."""
    before = left.columns
    out = join_forms(left, rights, keys)
    return fill_missing(out, 0, only=other_columns(out, before))


def exists_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """1 where the key occurs in ``other``, else 0. Keys are made unique first."""
    hits = other.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return (
        balanced_join(df, hits, keys, right_unique=True)
        .withColumn(out, F.coalesce(F.col("_hit"), F.lit(0)))
        .drop("_hit")
    )


# --- dictionaries -----------------------------------------------------------


def first_label(df: DataFrame, code: str, label: str) -> DataFrame:
    """One label per code: the first in ascending order, missing labels last.

    ``min`` skips missing labels and combines before the shuffle; no sort, no window.
    """
    return df.groupBy(code).agg(F.min(label).alias(label))


def map_values(c: Column, names: dict) -> Column:
    """A literal dictionary of a few dozen entries; unknown values become null."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def lookup(
    df: DataFrame,
    key: Column,
    dictionary: DataFrame,
    code: str,
    label: str,
    out: str,
    default: str | None = None,
) -> DataFrame:
    """Label of ``key`` from a dictionary table, ``default`` for unknown codes.

    A code that exists with a missing label stays missing.
    """
    entries = first_label(dictionary.filter(col(code).isNotNull()), code, label).select(
        col(code).cast("string").alias("_code"),
        col(label).alias("_label"),
        F.lit(True).alias("_known"),
    )
    joined = df.withColumn("_key", key.cast("string")).join(
        entries, F.col("_key") == F.col("_code"), "left"
    )
    value = F.col("_label")
    if default is not None:
        value = F.when(F.col("_known"), value).otherwise(F.lit(default))
    return joined.withColumn(out, value).drop("_key", "_code", "_label", "_known")


def codes_to_names(
    df: DataFrame,
    codes: DataFrame,
    form: str,
    alias: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Recode every coded column of one form through the code table.

    ``codes`` has ``form, variable, value, name``. ``alias`` maps a variable of the code
    table to the column it describes when the two differ. Returns the recoded table and
    ``errors(form, variable, problem, n)``: variables without a column, and values that
    have no name. Unknown values become null. One name per code, the greatest one.
    """
    alias = alias or {}
    spark = df.sparkSession
    known = (
        codes.filter(F.col("form") == form)
        .select("variable", normalise_code(F.col("value"), missing=None).alias("_code"), "name")
        .filter(F.col("_code").isNotNull() & F.col("variable").isNotNull())
    )
    # One row per coded variable of a form: bounded by the number of its columns.
    variables = sorted(r["variable"] for r in known.select("variable").distinct().collect())
    if not variables:
        return df, literal_table(spark, [], "form string, variable string, problem string, n bigint")
    absent = [(form, v, "no such column", None) for v in variables if alias.get(v, v) not in df.columns]
    checks = [v for v in variables if alias.get(v, v) in df.columns]
    # The whole dictionary of the form is one value, read once for all variables: names by variable and code.
    names = known.groupBy("variable", "_code").agg(F.max("name").alias("_name"))
    entry = F.struct("_code", "_name")
    by_code = names.groupBy("variable").agg(F.map_from_entries(F.collect_list(entry)).alias("_names"))
    dictionary = by_code.agg(F.map_from_entries(F.collect_list(F.struct("variable", "_names")))).scalar() if checks else None
    recoded, lost = {}, []
    for v in checks:
        column = alias.get(v, v)
        mine = F.element_at(dictionary, F.lit(v))
        key = F.coalesce(normalise_code(col(column), missing=None), col(column).cast("string"))
        recoded[column] = F.element_at(mine, key)
        lost.append((col(column).isNotNull() & ~F.map_contains_key(mine, key)).alias(f"_lost_{v}"))
    out = df.select(*[recoded[c].alias(c) if c in recoded else col(c) for c in df.columns], *lost)
    errors = literal_table(spark, absent, "form string, variable string, problem string, n bigint")
    if checks:
        lost = out.agg(*[F.count_if(col(f"_lost_{v}")).alias(f"_n{i}") for i, v in enumerate(checks)])
        cells = F.explode(
            F.array(
                *[F.struct(F.lit(v).alias("v"), F.col(f"_n{i}").alias("n")) for i, v in enumerate(checks)]
            )
        )
        errors = errors.unionByName(
            lost.select(cells.alias("c"))
            .filter(F.col("c.n") > 0)
            .select(
                F.lit(form).alias("form"),
                F.col("c.v").alias("variable"),
                F.lit("value without a name").alias("problem"),
                F.col("c.n").cast("bigint").alias("n"),
            )
        )
    return out.select(*[col(c) for c in df.columns]), errors
