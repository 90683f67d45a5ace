"""Min-max scaling learnt on one table and applied to any other."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import col, known, scale_between


@dataclass(frozen=True)
class MinMax:
    """Column bounds; constant columns map to 0. Plain column arithmetic, no vectors."""

    bounds: dict[str, tuple[float | None, float | None]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> MinMax:
        if not columns:
            return cls({})
        row = df.agg(
            *[F.min(known(col(c).cast("double"))).alias(f"lo{i}") for i, c in enumerate(columns)],
            *[F.max(known(col(c).cast("double"))).alias(f"hi{i}") for i, c in enumerate(columns)],
        ).first()
        return cls({c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            low, high = self.bounds.get(c, (None, None))
            if low is None:
                out.append(col(c))
            else:
                out.append(scale_between(known(col(c).cast("double")), low, high).alias(c))
        return df.select(*out)

    def save(self, spark, path: str) -> None:
        rows = [(c, lo, hi) for c, (lo, hi) in self.bounds.items()]
        schema = "column string, low double, high double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> MinMax:
        rows = spark.read.parquet(path).collect()  # one row per column
        return cls({r["column"]: (r["low"], r["high"]) for r in rows})
