"""Connected components of an edge table: smallest labels of neighbours, then labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardtable.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` (the smallest node that can be reached) for every node of an edge.

    Each round takes the smallest label among the neighbours and follows labels once, so the
    number of rounds follows the logarithm of the longest path. Labels are unique per node, so in
    every join only the side of the edges can hold a hot node, and such joins can be split.
    Every round is written to the shared folder. No edges: no rows. Repeated edges, edges of a node
    with itself and edges without one of their ends don't matter.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = saved(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), "labels")
    while True:
        beside = (
            both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("_low"))
        )
        lower = labels.join(beside, "u", "left").select("u", "label", F.least("label", "_low").alias("_new"))
        after = labels.select(F.col("u").alias("_new"), F.col("label").alias("_next"))
        labels = saved(
            lower.join(after, "_new", "left").select(
                "u",
                F.least("_new", "_next").alias("label"),
                (F.least("_new", "_next") < F.col("label")).alias("_changed"),
            ),
            "labels",
        )
        if labels.filter("_changed").isEmpty():
            return labels.select(F.col("u").alias("node"), "label")
        labels = labels.drop("_changed")
