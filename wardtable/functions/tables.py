"""Small tables from driver-side facts (reports, name lists), built without Python workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of literals as a table; ``schema`` like ``"name string, n bigint"``."""
    fields = [tuple(part.strip().rsplit(" ", 1)) for part in schema.split(", ")]
    if not rows:
        empty = [F.lit(None).cast(t).alias(n) for n, t in fields]
        return spark.range(0, 0, 1, 1).select(*empty)
    cells = [
        F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(fields, row)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*cells)))
