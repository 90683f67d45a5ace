"""What each filter removes in each order of filters, by recursive enumeration over mask cells.

Every document gets a mask with a bit for each filter that it fails. Documents with one part and
mask are one cell, so at most 2 ** filters cells stand for a part. A recursive query starts with the
masks that occur and extends the prefix of applied filters by an unused letter in each level, joined on the
bits applied so far; each level says for every mask what its step does to it. The prefixes are joined with
the cells, and every order takes the step of each of its prefixes.

The recursion sees masks and not parts, so its size depends on the number of filters alone: 326
prefixes for five. Copies are found without listing a group: the smallest key of each text is
aggregated, and rows look it up by text and key together, which no large group shares.

A null text is an empty one, a null part the empty string. Rows without a key are copies of nothing and nobody's original
nor labelled; rows with one key and text are all first or all copies. Of several labels for a key any
1 counts. Other columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardtable.llm.common import col, map_text, saved

FILTERS = "ABCDE"
UPPER = bytes(range(65, 91))
_SYMBOL = re.compile(r"[#$%&*|]").search


def text_mask(text: str) -> int:
    """Bits of the filters that look at a text alone: A few words, B few distinct words, C capitals, D symbols."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * capitals > 5 * len(text)) << 2
        | (_SYMBOL(text) is not None) << 3
    )


def masks(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``key``, ``part``, ``mask`` and ``n``: how many rows have these; bit 4 of the mask (E) is a copy of a smaller key's text."""

    def work() -> Callable[[list[str]], list[tuple]]:
        def row(t: str) -> tuple:
            return text_mask(t), hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest()

        return lambda texts: [row(t) for t in texts]

    told = map_text(df.select(col(key).alias("key"), col(part).alias("part"), col(text).alias("text")), "text", "mask int, digest binary", work, ["key", "part"])
    rows = told.groupBy("digest", "key", F.coalesce("part", F.lit("")).alias("part"), "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = saved(rows, "masks")
    first = rows.groupBy("digest").agg(F.min("key").alias("key")).filter("key is not null").withColumn("_first", F.lit(True))
    copy = F.col("key").isNotNull() & F.col("_first").isNull()
    rows = rows.join(first, ["digest", "key"], "left")
    return rows.select("key", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"), "n")


def cells(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``part``, ``mask`` and how many documents, good ones and toxic ones each cell has."""

    def any_one(c: str) -> Column:
        return F.max(F.when(col(c) == 1, 1).otherwise(0)).cast("bigint")

    told = labels.groupBy(col(key).alias("key")).agg(any_one("quality").alias("good"), any_one("toxic").alias("toxic"))
    rows = masked.join(told.filter("key is not null"), "key", "left")
    counts = [F.sum("n").alias("docs"), *[F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")]]
    return rows.groupBy("part", "mask").agg(*counts)


def _extensions(filters: str) -> str:
    """SQL rows (applied, letter, bit): which letters may follow the bits applied so far."""
    return ", ".join(
        f"({applied}, '{letter}', {1 << i})" for applied in range(1 << len(filters)) for i, letter in enumerate(filters) if not applied >> i & 1
    )


def prefixes(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every prefix of every order and every mask of ``found``: what the prefix's last step does to the mask.

    ``prefix``, ``step``, ``letter``, ``mask`` and the flags ``kept``, ``removed``, ``redundant`` and ``unique_fails``.
    """
    sql = f"""
    WITH RECURSIVE following(applied, letter, bit) AS (VALUES {_extensions(filters)}),
    steps(prefix, applied, step, mask, letter, kept, removed, redundant, unique_fails) AS (
      SELECT '', 0, 0, mask, '', true, false, false, false FROM {{masks}}
      UNION ALL
      SELECT s.prefix || f.letter, s.applied | f.bit, s.step + 1, s.mask, f.letter,
             s.mask & (s.applied | f.bit) = 0, s.mask & s.applied = 0 AND s.mask & f.bit <> 0,
             s.mask & s.applied <> 0 AND s.mask & f.bit <> 0, s.mask = f.bit
      FROM steps s JOIN following f ON s.applied = f.applied
    )
    SELECT prefix, step, letter, mask, kept, removed, redundant, unique_fails FROM steps WHERE step > 0
    """
    return found.sparkSession.sql(sql, masks=found.select("mask").distinct())


def audit(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts of the step; see the module. ``found`` is what ``cells`` returns."""
    fates = saved(prefixes(found, filters), "prefixes")
    # Prefixes times masks: a number that the filters set, 10,400 rows for five of them.
    met = found.join(F.broadcast(fates), "mask")

    def total(flag: str, count: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(count)).otherwise(0))

    steps = met.groupBy("part", "prefix", "letter").agg(
        total("kept", "docs").alias("kept"), total("removed", "docs").alias("removed"), total("redundant", "docs").alias("redundant"),
        total("unique_fails", "docs").alias("unique_fails"), total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"),
    )
    n = len(filters)
    orders = fates.filter(F.col("step") == n).select(F.col("prefix").alias("filter_order")).distinct()
    places = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    places = places.withColumn("prefix", F.expr("left(filter_order, step)"))
    every = steps.join(F.broadcast(places), "prefix")
    # One part's rows for one filter: as many as there are orders.
    return every.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters on whole texts of documents, for every source and order."""
    found = saved(cells(masks(docs), labels), "cells")
    return audit(found)
