"""Repeatable train/test splits and folds from the hash of a unique row key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import col
from wardtable.operators.ordered import HASH_BITS, hash_rank

SEED = 99  # fixed value: the seed of every split in the study


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed).cast("string")))


def _below(digest: Column, share: float) -> Column:
    """Whether ``ordered.hash_number`` is below ``share`` of its range: its hexadecimal digits compare as the number does."""
    bound = int(share * (1 << HASH_BITS))
    return digest < F.lit(f"{bound:0{HASH_BITS // 4}x}") if bound < 1 << HASH_BITS else F.lit(True)


def in_test(key: Column, share: float = 0.3, seed: int = SEED) -> Column:
    """True for about ``share`` of the keys; needs no shuffle and survives re-runs."""
    return _below(_digest(key, seed), share)


def part_of(key: Column, test: float = 0.3, validation: float = 0.0, seed: int = SEED) -> Column:
    """0 for a test, 1 for a validation and 2 for a training row: the parts of ``split`` and ``three_way`` as a column."""
    h = _digest(key, seed)
    part = F.when(_below(h, test), F.lit(0))
    if validation:  # a second branch hashes again
        part = part.when(_below(h, test + validation), F.lit(1))
    return part.otherwise(F.lit(2))


def split(
    df: DataFrame, key: str, share: float = 0.3, seed: int = SEED, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Train and test tables. ``exact`` makes the test part ``ceil(share * n)`` rows."""
    if not exact:
        mark = in_test(col(key), share, seed)
        return df.filter(~mark), df.filter(mark)
    size = math.ceil(round(share * df.count(), 9))
    ranked = hash_rank(df, key, seed, out="_rank")
    return (
        ranked.filter(F.col("_rank") >= size).drop("_rank"),
        ranked.filter(F.col("_rank") < size).drop("_rank"),
    )


def three_way(
    df: DataFrame, key: str, validation: float = 0.2, test: float = 0.3, seed: int = SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test parts, so that tuning never sees the test rows."""
    h = _digest(col(key), seed)
    a, b = _below(h, test), _below(h, test + validation)
    return df.filter(~b), df.filter(~a & b), df.filter(a)


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int = 10, seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Fold number 0..folds-1, each class dealt out evenly (sizes differ by at most one)."""
    ranked = hash_rank(df, key, seed, by=[label], out="_rank")
    return ranked.withColumn(out, (F.col("_rank") % folds).cast("int")).drop("_rank")
