"""Quality rules on documents and on their hosts, in DataFrame functions only.

Every document gets its counts and the verdict of the base rules. Failures are then summed up by host
(here the source), each host's failure rate is drawn towards the rate of all hosts by a beta prior
whose two numbers come from the mean and the variance of the hosts' rates, and the verdict on the
host is joined back: documents of a host that fails more often than not go as well.

Null texts have no words and fail. A null host is a host of its own. Repeated rows count as often as
they occur. Counts are kept in one narrow table in the shared folder, so that each text is read once; host
totals are summed up before they are shuffled, so a host with a third of all rows is one row per task. Further columns
are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.llm.common import WORD, col, saved

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: A host whose drawn-in failure rate is above this is rejected.
MOST_FAILURES = 0.5
#: The prior counts as at most so many documents, however alike the hosts are.
STRONGEST_PRIOR = 1000.0
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more, the first one included.

    Windows are compared by 64-bit hashes, sorted with their places, so the work follows n log n.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    def marked(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            same = (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"])
            return F.coalesce(same, F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)

    def count(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        several = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(several, let(ordered, lambda o: let(marked(o), covered))).otherwise(F.lit(0).cast("bigint"))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    many = F.size(words) > WINDOW
    return F.when(many, let(hashes, lambda h: let(windows(h), count))).otherwise(F.lit(0).cast("bigint"))


def measures(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``_id``, ``_host``, the five counts and ``base_failed`` for every row."""
    whole = F.coalesce(col(text), F.lit(""))
    read = df.select(
        col(key).alias("_id"),
        col(host).alias("_host"),
        whole.alias("_text"),
        F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("_words"),
    )
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD))
    bare = F.translate("_text", SPACES, "")
    counted = read.select(
        "_id",
        "_host",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_verdicts(counted: DataFrame) -> DataFrame:
    """``_host``, documents, failures, ``failure_rate`` (drawn in) and ``host_kept``, a row for each host.

    Prior: mean m and variance v of the hosts' rates give a + b = m (1 - m) / v - 1, kept between 1 and
    ``STRONGEST_PRIOR``; a = m (a + b). One row of two numbers passes through the driver.
    """
    hosts = counted.groupBy("_host").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("base_failed").alias("failures")
    )
    rate = F.col("failures") / F.col("documents")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    mean, spread = moments["m"] or 0.0, moments["v"] or 0.0
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else STRONGEST_PRIOR
    weight = min(max(weight, 1.0), STRONGEST_PRIOR)
    drawn = (F.col("failures") + F.lit(mean * weight)) / (F.col("documents") + F.lit(weight))
    return hosts.withColumn("failure_rate", drawn).withColumn("host_kept", F.col("failure_rate") <= MOST_FAILURES)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``key``, the counts, ``base_failed``, ``failure_rate`` of the host and ``kept``, a row for each row."""
    counted = saved(measures(df, key, text, host), "measures")
    verdicts = host_verdicts(counted).select(F.col("_host").alias("_judged"), "failure_rate", "host_kept")
    joined = counted.join(verdicts, F.col("_host").eqNullSafe(F.col("_judged")), "left")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failure_rate"]
    return joined.select(F.col("_id").alias(key), *names, (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
