"""Running totals and ranks over a whole table without a single-task window.

An ``OVER (ORDER BY ...)`` without a partition sends every row to one task. Here
the order is cut into buckets first; a window runs inside each bucket, and the
bucket totals (one row per bucket, so a bounded table) give each bucket its start.
The same exchange feeds both branches, so the input is shuffled once.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardtable.functions.expressions import col, known

#: Narrow rows that one task sorts with ease; the number of buckets follows from it.
BUCKET_ROWS = 5_000_000
HASH_BITS = 60
#: A value that occurs more often is looked up in a broadcast table, so that its rows don't meet in one task.
OFTEN = 100_000
#: Starts of buckets up to which they go to every task.
LISTED_STARTS = 100_000


def default_buckets(df: DataFrame) -> int:
    """At least one bucket per shuffle partition, and as many as the number of rows asks for (one counting job)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, parts, -(-df.count() // BUCKET_ROWS))


def hash_number(*parts: Column) -> Column:
    """Repeatable 60-bit number from the md5 of the parts; plain SQL can repeat it."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def add_buckets(df: DataFrame, order_by: str, buckets: int, out: str = "_bucket") -> DataFrame:
    """Bucket number that never decreases with ``order_by``, near-equal bucket sizes.

    One job finds at most ``buckets - 1`` approximate quantiles (a mergeable sketch,
    so it pre-aggregates). Their exact place affects balance only, never results.
    Missing values go to bucket -1.
    """
    shares = [i / buckets for i in range(1, buckets)]
    value = col(order_by).cast("double")
    cuts = df.agg(F.percentile_approx(value, shares, 10_000).alias("c")).first()["c"] or []
    splits = [float("-inf"), *(sorted({c for c in cuts}) or [0.0]), float("inf")]  # any cut does without a value
    ready = df.withColumn("_order", value)
    return (
        Bucketizer(splits=splits, inputCol="_order", outputCol="_place", handleInvalid="keep")
        .transform(ready)
        .withColumn(out, F.coalesce(F.col("_place").cast("int"), F.lit(-1)))
        .drop("_order", "_place")
    )


def running(
    df: DataFrame,
    order_by: str,
    totals: dict[str, tuple[str, str]],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``min`` along ``order_by``, whole-table or inside ``by``.

    ``totals`` maps each new column to ``(function, column)``. The order value must be
    unique inside ``by`` (group by it first), which also keeps every bucket small no
    matter how often a value repeats in the raw rows. ``exclusive`` leaves the own row out.
    """
    buckets = buckets or default_buckets(df)
    by = list(by)
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    cut = add_buckets(df, order_by, buckets)
    per_bucket = cut.groupBy(*by, "_bucket").agg(
        *[fns[f](col(c)).alias(f"_own_{o}") for o, (f, c) in totals.items()]
    )
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    # At most `buckets` rows per `by` group reach this window.
    before = Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = per_bucket.select(
        *by,
        "_bucket",
        *[fns[f](F.col(f"_own_{o}")).over(before).alias(f"_start_{o}") for o, (f, _) in totals.items()],
    )
    order = col(order_by).desc() if descending else col(order_by).asc()
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0
    )
    local = cut.select(
        "*", *[fns[f](col(c)).over(inside).alias(f"_local_{o}") for o, (f, c) in totals.items()]
    )
    joined = local.join(starts, [*by, "_bucket"], "left")
    out = []
    for o, (f, _) in totals.items():
        start, here = F.col(f"_start_{o}"), F.col(f"_local_{o}")
        if f == "sum":
            zero = F.lit(0)
            out.append((F.coalesce(start, zero) + F.coalesce(here, zero)).alias(o))
        elif f == "max":
            out.append(F.greatest(start, here).alias(o))
        else:
            out.append(F.least(start, here).alias(o))
    return joined.select(*[col(c) for c in df.columns], *out)


def average_ranks(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """One row for each row of ``df``: ``ranks``, an array with each column's average rank among its values, from 1 on.

    Equal values share the mean of their places; missing ones have none. Values are counted first, so
    ties cost nothing, then summed along each column in buckets of near-equal size cut at its own
    approximate quantiles (at most ``buckets`` numbers a column reach the driver). All columns go together: two shuffles of the cells.
    """
    buckets = buckets or default_buckets(df)
    values = [known(col(c).cast("double")) for c in columns]
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"c{k}") for k, v in enumerate(values)]).first()
    rows = [(k, sorted(set(c or []))) for k, c in enumerate(cuts)]
    cuts = df.sparkSession.createDataFrame(rows, "_column int, _cuts array<double>")
    cells = df.select(F.monotonically_increasing_id().alias("_row"), F.array(*values).alias("_values"))
    cells = cells.select("_row", F.posexplode("_values").alias("_column", "_value"))
    counts = cells.filter("_value is not null").groupBy("_column", "_value").agg(F.count(F.lit(1)).alias("_n"))
    place = F.size(F.filter("_cuts", lambda c: c < F.col("_value")))
    counts = counts.join(F.broadcast(cuts), "_column").select("_column", "_value", "_n", place.alias("_bucket"))
    totals = counts.groupBy("_column", "_bucket").agg(F.sum("_n").alias("_own"))
    # At most ``buckets`` rows per column reach this window.
    before = Window.partitionBy("_column").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_column", "_bucket", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_column", "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("_here", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ranks = local.join(starts, ["_column", "_bucket"]).select(
        "_column", "_value", "_n", (F.col("_start") + F.col("_here") + (F.col("_n") + 1) / 2).alias("_rank")
    )
    # At most one row for ``OFTEN`` cells. Cells that have their rank, or no value, are dealt out by row in the second join.
    often = ranks.filter(F.col("_n") > OFTEN).select("_column", "_value", F.col("_rank").alias("_known"))
    rare = ranks.filter(F.col("_n") <= OFTEN).select("_column", "_value", "_rank", F.lit(0).cast("bigint").alias("_deal"))
    found = F.col("_known").isNotNull() | F.col("_value").isNull()
    cells = cells.join(F.broadcast(often), ["_column", "_value"], "left").select(
        "_row", "_column", "_known", F.coalesce("_value", F.lit(0.0)).alias("_value"), F.when(found, F.col("_row") + 1).otherwise(F.lit(0)).alias("_deal")
    )
    ranked = cells.join(rare, ["_column", "_value", "_deal"], "left").withColumn("_rank", F.coalesce("_known", "_rank"))
    wide = [F.max(F.when(F.col("_column") == k, F.col("_rank"))) for k in range(len(columns))]
    return ranked.groupBy("_row").agg(F.array(*wide).alias("ranks")).select("ranks")


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int,
    by: Sequence[str] = (),
    out: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """0-based rank by the hash of ``key`` (unique), whole-table or inside ``by``.

    Hash values are uniform, so fixed ranges of them are equal buckets and no
    quantile job is needed; a huge ``by`` group is spread over all buckets.
    """
    buckets = buckets or default_buckets(df)
    by = list(by)
    step = (1 << HASH_BITS) // buckets + 1
    ready = df.withColumn("_hash", hash_number(col(key), F.lit(seed))).withColumn(
        "_bucket", F.floor(F.col("_hash") / F.lit(step)).cast("int")
    )
    counts = ready.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most `buckets` rows per `by` group reach this window.
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    # Rows are dealt out once, whole, by their bucket; both windows take them as they lie.
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", col(key))
    placed = ready.repartition("_bucket").withColumn("_row", F.row_number().over(inside))
    groups = df.agg(F.approx_count_distinct(F.struct(*by))).first()[0] if by else 1
    starts = F.broadcast(starts) if groups * buckets <= LISTED_STARTS else starts
    same = functools.reduce(Column.__and__, [F.col("_bucket") == F.col("_of"), *[col(c) == F.col(f"_by{i}") for i, c in enumerate(by)]])
    ranked = placed.join(starts, same, "left").withColumn("_rank", (F.col("_start") + F.col("_row") - 1).cast("bigint"))
    # Rows with one key each take every rank of that key.
    alike = Window.partitionBy("_bucket", "_hash", key)
    ranks = F.collect_list(F.struct(F.col("_rank").alias("r"))).over(alike)
    return ranked.withColumn("_ranks", ranks).select(*[col(c) for c in df.columns], F.explode(F.col("_ranks")["r"]).alias(out))
