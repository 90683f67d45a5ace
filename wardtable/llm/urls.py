"""URL filters that spread along links, in DataFrame functions only.

Rules judge the pages they fit, the longest rule first. Their verdicts are seeds: trust flows from hosts of
allowed pages along links (personalised PageRank), distrust from hosts of blocked pages against them, as
who links to a blocked host is suspect. A host whose distrust is above its trust is blocked, and pages
without a rule take the verdict of their host.

Null urls and urls without ``://`` have an empty host and path. Links are absolute ones; those within a host
don't count. A host without any seed or link has neither trust nor distrust and is allowed. Repeated
pages count as often as they occur. Pages are read once; what goes on is one narrow row for each. In the joins of a round,
ranks are unique per host, so only the side of the links can hold a hot host, and sums are made before the shuffle.
Further columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.llm.common import col, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a host's score that its links pass on.
DAMPING = 0.85
#: Rounds stop when each host's last change is at most this share of its own score.
SETTLED = 1e-3
LINK = "(?is)<a\\s[^>]*?\\bhref\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"

Rule = tuple[str, str, str]  # allow or block, host, path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and action; null if none does."""

    def fits(rule: Rule) -> Column:
        _, name, start = rule
        return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))

    def struct(rule: Rule) -> Column:
        return F.struct(F.lit(rule[1] + rule[2]).alias("rule"), F.lit(rule[0]).alias("action"))

    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    chain = reduce(lambda c, r: c.when(fits(r), struct(r)), ordered[1:], F.when(fits(ordered[0]), struct(ordered[0])))
    return chain


def spread(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` from ``links`` (source, target, n) and ``seeds`` (host, trust, distrust).

    Each round is written to the shared folder. Weights of a host's links add up to one, for trust over those
    that leave it, for distrust over those that lead to it, so a round passes on less than it had and the
    changes shrink by the damping. They go on until no round reaches a further host and every score, of either kind, is
    settled by its own measure: the number of rounds depends on the longest chain of links, not on the seeds elsewhere.
    """
    out = links.groupBy("source").agg(F.sum("n").alias("_all"))
    into = links.groupBy("target").agg(F.sum("n").alias("_all"))
    forward = links.join(out, "source").select(
        F.lit("trust").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), (F.col("n") / F.col("_all")).alias("w")
    )
    backward = links.join(into, "target").select(
        F.lit("distrust").alias("kind"), F.col("target").alias("a"), F.col("source").alias("b"), (F.col("n") / F.col("_all")).alias("w")
    )
    arcs = saved(forward.unionByName(backward), "arcs")
    start = saved(
        seeds.select(F.col("host").alias("a"), F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "score"))
        .filter("score > 0")
        .withColumn("score", F.col("score") * (1 - DAMPING)),
        "seeds",
    )
    # What arrives in a round is what the last round's change passes on; scores are the sum of all changes.
    change, scores = start, start
    while True:
        change = saved(
            arcs.join(change, ["kind", "a"])
            .groupBy("kind", F.col("b").alias("_b"))
            .agg((F.sum(F.col("w") * F.col("score")) * DAMPING).alias("score"))
            .select(F.col("_b").alias("a"), "kind", "score"),
            "ranks",
        )
        both = scores.select("a", "kind", "score", F.lit(0.0).alias("moved")).unionByName(change.withColumn("moved", F.col("score")))
        scores = saved(both.groupBy("a", "kind").agg(F.sum("score").alias("score"), F.sum("moved").alias("moved")), "scores")
        # A host that is reached for the first time has moved by all of its score.
        if scores.filter(F.col("moved") > SETTLED * F.col("score")).isEmpty():
            break

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(F.lit(0.0))).alias(kind)

    return scores.groupBy(F.col("a").alias("host")).agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (null without one) and ``verdict``, a row for each page."""
    read = pages.select(
        col(key).alias("_id"),
        host_of(col(url)).alias("host"),
        path_of(col(url)).alias("path"),
        F.transform(
            F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(LINK), F.lit(1)),
            lambda h: F.translate(h, UPPER, LOWER),
        ).alias("_links"),
    )
    judged = saved(read.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules)), "judged")
    links = (
        judged.select(F.col("host").alias("source"), F.explode("_links").alias("target"))
        .filter("source <> target and source <> ''")
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seeds = judged.filter("_fit is not null").groupBy("host").agg(
        F.count_if(F.col("_fit.action") == "allow").cast("double").alias("trust"),
        F.count_if(F.col("_fit.action") == "block").cast("double").alias("distrust"),
    )
    known = spread(saved(links, "host-links"), seeds)
    hosts = known.select(F.col("host").alias("_judged"), (F.col("distrust") > F.col("trust")).alias("_blocked"))
    joined = judged.join(hosts, F.col("host") == F.col("_judged"), "left")
    by_host = F.when(F.coalesce("_blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        F.col("_id").alias(key), "host", "path", F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.action"), by_host).alias("verdict"),
    )
