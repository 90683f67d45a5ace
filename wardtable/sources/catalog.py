"""A database of forms as a dict of DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardtable.functions.expressions import col, known
from wardtable.functions.tables import literal_table
from wardtable.operators.columns import rename_columns
from wardtable.operators.joins import codes_to_names

FORMATS = ("parquet", "csv")


def table_names(spark: SparkSession, path: str, fmt: str = "parquet") -> list[str]:
    """Names of the tables in a folder (``name.parquet`` or ``name/`` entries), sorted."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = [str(s.getPath().getName()) for s in fs.listStatus(hadoop)]
    suffix = "." + fmt
    return sorted(
        {e.removesuffix(suffix) for e in entries if e.endswith(suffix) or "." not in e}
        - {e for e in entries if e.startswith(("_", "."))}
    )


def load_catalog(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Every table of a folder, lazily: nothing is read until a query needs it."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is not one of {FORMATS}")
    out = {}
    for name in table_names(spark, path, fmt):
        file = os.path.join(path, f"{name}.{fmt}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        where = file if fs.exists(hadoop) else os.path.join(path, name)
        out[name] = nan_to_null(read_csv(spark, where, **options) if fmt == "csv" else spark.read.parquet(where))
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in number columns, the missing marker of tables written from pandas, becomes null."""
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not numbers:
        return df
    return df.select(*[known(col(c)).alias(c) if c in numbers else col(c) for c in df.columns])


def load_jdbc(
    spark: SparkSession,
    url: str,
    tables: dict[str, dict],
    **options,
) -> dict[str, DataFrame]:
    """Tables of a database server over JDBC.

    ``tables`` maps a name to its read options; give ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` there, so that large tables are read in parallel.
    """
    return {
        name: nan_to_null(spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options, **own).load())
        for name, own in tables.items()
    }


def describe_catalog(catalog: dict[str, DataFrame]) -> DataFrame:
    """``(form, columns)``: the form's name with ``tbl`` spelled out, and its columns."""
    rows = [(n.replace("tbl", "formulario"), ", ".join(df.columns)) for n, df in sorted(catalog.items())]
    spark = next(iter(catalog.values())).sparkSession
    return literal_table(spark, rows, "form string, names string").select(
        "form", F.split("names", ", ").alias("columns")
    )


def recode_catalog(
    catalog: dict[str, DataFrame], codes: DataFrame, alias: dict[str, str] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Recodes every form; the form name is the table name without ``tbl_``."""
    out, errors = {}, None
    for name in sorted(catalog):
        df, found = codes_to_names(catalog[name], codes, name.removeprefix("tbl_"), alias)
        out[name] = df
        errors = found if errors is None else errors.unionByName(found)
    return out, errors


# --- csv --------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema=None, index: tuple[str, ...] = ("Unnamed: 0", "_c0", "")) -> DataFrame:
    """CSV with a header; empty cells are missing, a leading unnamed index column is dropped.

    Give a ``schema`` for large files; without one an extra pass infers it.
    """
    reader = spark.read.option("header", True).option("nullValue", "")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    first = df.columns[0]
    return df.drop(first) if first in index else df


def write_csv(df: DataFrame, path: str, separator: str = ", ") -> None:
    """CSV with a header and no index; lists become joined text. Written in parallel."""
    from wardtable.functions.expressions import col

    flat = df.select(
        *[
            (F.array_join(col(n), separator) if t.startswith("array") else col(n)).alias(n)
            for n, t in df.dtypes
        ]
    )
    flat.write.mode("overwrite").option("header", True).csv(path)


def drop_index(df: DataFrame, names: tuple[str, ...] = ("Unnamed: 0", "_c0")) -> DataFrame:
    return df.drop(*names)


def renamed_forms(catalog: dict[str, DataFrame], names: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """Columns renamed per table before use, for data with other spellings."""
    return {t: rename_columns(df, names.get(t, {})) for t, df in catalog.items()}
