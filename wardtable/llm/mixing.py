"""Mixing sources to target weights by a minimum-cost flow, for sources that may overlap.

Documents are first summed up by membership pattern, the set of sources that hold them: a table with
one row per pattern. Its words flow to the sources' quotas. Each repetition of a pattern is an arc of
its own with the pattern's words as capacity and a higher cost than the one before, so that a word is
taken a second time only where no first time is left. The flow says how many words each
pattern gives; whole rounds take every document of it, the rest takes documents in a seeded order
as long as they fit and then the one further document whose size comes nearest to what is missing.

Patterns and sources are tables and stay in Spark: places of the sources in code point order come from a range
partitioning, targets from a few sums over the sources. A pattern whose one source no other pattern shares has only one
way to flow, which is arithmetic. The other patterns are grouped by connected components of their sources, and each
component's flow is computed in a task of its own, which holds one row per pattern of it. Nothing goes through the driver
but sums, and small tables are broadcast only where Spark finds their written size below its limit. The place where a pattern's
seeded order ends is found by two grouped counts over 4096 ranges of the hash each, and only the documents of one small
range are sorted.

Null texts have size 0, a null source is a source of its own and the last one; a document with no list of sources, or an
empty one, belongs to it. No words: targets are
0. Each row is a document of its own, also where rows share a key or have none. Extra columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardtable.llm.common import WORD, col, free_name, saved
from wardtable.llm.components import components

#: No document is taken more often.
ROUNDS = 3
WEIGHTS = (5, 2, 1)
_RANGE_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


# --- the flow of one component ------------------------------------------------


def _levels(patterns, spare, left, holders) -> tuple[dict[int, int], dict[int, int]] | None:
    """Distance of patterns and sources from patterns with words to spare, up to the first sources that lack some."""
    near_patterns = {i: 0 for i, words in enumerate(spare) if words}
    near_sources: dict[int, int] = {}
    layer, depth = list(near_patterns), 0
    while layer:
        depth += 1
        reached = []
        for i in layer:
            for s in patterns[i][0]:
                if s not in near_sources:
                    near_sources[s] = depth
                    reached.append(s)
        if any(left[s] for s in reached):
            return near_patterns, near_sources
        depth += 1
        layer = []
        for s in reached:
            for j in holders[s]:
                if j not in near_patterns:
                    near_patterns[j] = depth
                    layer.append(j)
    return None


def _send(patterns, spare, left, sent, holders) -> bool:
    """Words moved along all shortest ways at once; false where no way is left."""
    found = _levels(patterns, spare, left, holders)
    if found is None:
        return False
    near_patterns, near_sources = found
    # What may come next on a way, with the place of the first one that is not spent.
    onward = {i: [s for s in patterns[i][0] if near_sources.get(s) == d + 1] for i, d in near_patterns.items()}
    back = {s: [j for j in holders[s] if near_patterns.get(j) == d + 1] for s, d in near_sources.items()}
    at_pattern, at_source = dict.fromkeys(onward, 0), dict.fromkeys(back, 0)
    for start in [i for i, words in enumerate(spare) if words]:
        way = [start]  # pattern, source, pattern, source, ...
        while way and spare[start]:
            here = way[-1]
            if len(way) % 2:
                if at_pattern[here] < len(onward[here]):
                    way.append(onward[here][at_pattern[here]])
                else:
                    way.pop()
                    if way:
                        at_source[way[-1]] += 1
                continue
            if left[here]:
                taken = [(way[k], way[k + 1]) for k in range(1, len(way) - 1, 2)]  # source, pattern that gives way
                words = min(spare[start], left[here], *[sent[j][s] for s, j in taken])
                for k in range(0, len(way), 2):
                    sent[way[k]][way[k + 1]] += words
                    holders[way[k + 1]].add(way[k])
                for s, j in taken:
                    sent[j][s] -= words
                    if not sent[j][s]:
                        holders[s].discard(j)
                spare[start] -= words
                left[here] -= words
                way = [start]
                continue
            options = back[here]
            while at_source[here] < len(options) and not sent[options[at_source[here]]].get(here):
                at_source[here] += 1
            if at_source[here] < len(options):
                way.append(options[at_source[here]])
            else:
                way.pop()
                at_pattern[way[-1]] += 1
    return True


def route(
    patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], costs: Sequence[int] = (0, 1, 3)
) -> list[list[int]]:
    """Words that each pattern (its sources, its words) gives in each round, by minimum-cost flow.

    A cheapest way never takes back what left the start, so the rounds, in order of their growing costs, are
    maximum flows one after the other on what the rounds before them left; all quotas are met as far as capacities allow.
    """
    if list(costs) != sorted(costs):
        raise ValueError("a later repetition can't be cheaper")
    left = list(quotas)
    sent = [dict.fromkeys(members, 0) for members, _ in patterns]
    holders: list[set[int]] = [set() for _ in quotas]
    out: list[list[int]] = [[] for _ in patterns]
    for _ in costs:
        spare = [words for _, words in patterns]
        while _send(patterns, spare, left, sent, holders):
            pass
        for i, (_, words) in enumerate(patterns):
            out[i].append(words - spare[i])
    return out


# --- sources and their targets ------------------------------------------------


def _placed(names: DataFrame) -> DataFrame:
    """``names`` with ``_s``, the place of ``_name`` in code point order, null last."""
    last = F.col("_name").isNull()
    at = F.monotonically_increasing_id()
    dealt = names.repartitionByRange(last, "_name").sortWithinPartitions(last, "_name")
    written = saved(
        dealt.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_in_part")), "places"
    )
    # One row for each partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_start", F.sum("_rows").over(before))
    place = F.coalesce("_start", F.lit(0)) + F.col("_in_part")
    return written.join(F.broadcast(starts), "_part").select(*names.columns, place.alias("_s"))


def source_targets(patterns: DataFrame, weights: Sequence[int] | None = None, most: int = ROUNDS) -> DataFrame:
    """``_name``, place ``_s``, ``_size``, ``_target`` and whole ``_quota`` of every source of ``patterns`` (_members, _words).

    All words are shared by weight; none gets over ``most`` times its size, the excess goes on by weight. ``weights`` by
    code point order of the sources, repeated as needed. Each sum settles the sources above their bound under the share
    of the one before, so that few are needed.
    """
    sizes = patterns.select("_words", F.explode("_members").alias("_name")).groupBy("_name").agg(F.sum("_words").alias("_size"))
    weights = list(weights or WEIGHTS)
    own = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_s") % len(weights) + 1).cast("int")).cast("bigint")
    sources = saved(_placed(sizes).withColumn("_weight", own), "sources")
    total = patterns.agg(F.sum("_words")).first()[0] or 0
    bound = F.col("_size") * most

    def above(rest: int, weight: int) -> Column:
        wide = "decimal(19,0)"
        return F.lit(rest).cast(wide) * F.col("_weight").cast(wide) > bound.cast(wide) * F.lit(weight).cast(wide)

    rest, weight, settled = total, sources.agg(F.sum("_weight")).first()[0] or 0, -1
    while True:
        over = above(rest, weight)
        found = sources.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, bound)).alias("words"), F.sum(F.when(~over, F.col("_weight"))).alias("weight")
        ).first()
        if found["n"] == settled or not found["weight"]:
            break
        rest, weight, settled = total - (found["words"] or 0), found["weight"], found["n"]
    share = (F.lit(rest) * F.col("_weight")).cast("double") / F.lit(float(weight or 1))
    target = F.when(above(rest, weight), bound.cast("double")).otherwise(share)
    return sources.select("_name", "_s", "_size", target.alias("_target"), F.rint(target).cast("bigint").alias("_quota"))


def pattern_shares(patterns: DataFrame, sources: DataFrame, costs: Sequence[int] = (0, 1, 3)) -> DataFrame:
    """For each pattern how many ``_whole`` rounds it gives, and the ``_rest`` of its words in one more."""
    patterns_by_source = patterns.select("_members", "_words", F.explode("_members").alias("_of"))
    known = sources.select("_name", "_s", "_quota")
    held = saved(patterns_by_source.join(known, F.col("_of").eqNullSafe(F.col("_name"))).drop("_of", "_name"), "held")
    several = F.size("_members") > 1
    give = F.least(F.col("_quota"), F.col("_words") * len(costs))
    columns = ["_members", F.when(F.col("_words") > 0, F.expr("_give div _words")).otherwise(0).cast("int").alias("_whole"),
               F.when(F.col("_words") > 0, F.col("_give") % F.col("_words")).otherwise(0).cast("bigint").alias("_rest")]
    if held.filter(several).isEmpty():
        return held.withColumn("_give", give).select(*columns)
    ends = held.filter(several).select("_members", F.col("_s").alias("b"))
    firsts = ends.groupBy("_members").agg(F.min("b").alias("a"))
    labels = components(ends.join(firsts, "_members").select("a", "b")).select(F.col("node").alias("_s"), "label")
    alone = held.join(labels, "_s", "left_anti").withColumn("_give", give).select(*columns)
    tied = held.join(labels, "_s").groupBy("_members", "label").agg(
        F.first("_words").alias("_words"), F.sort_array(F.collect_list(F.struct("_s", "_quota"))).alias("_sources")
    )

    def flow(table: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(table["_sources"], table["_words"], table["_members"], strict=True), key=lambda r: [e["_s"] for e in r[0]])
        quotas = {e["_s"]: e["_quota"] for r in rows for e in r[0]}
        number = {s: i for i, s in enumerate(sorted(quotas))}
        given = route([([number[e["_s"]] for e in r[0]], int(r[1])) for r in rows], [int(quotas[s]) for s in sorted(quotas)], costs)
        shares = [divmod(sum(g), int(r[1])) if r[1] else (0, 0) for g, r in zip(given, rows, strict=True)]
        return pd.DataFrame({"_members": [list(r[2]) for r in rows], "_whole": [w for w, _ in shares], "_rest": [x for _, x in shares]})

    flowed = tied.groupBy("label").applyInPandas(flow, "_members array<string>, _whole int, _rest bigint")
    return alone.unionByName(flowed)


# --- documents ----------------------------------------------------------------


def seeded_number(key: Column, seed: int) -> Column:
    """60 bits of the md5 of key and seed, which plain SQL can repeat."""
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def plan_mix(sized: DataFrame, weights: Sequence[int] | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """``sized`` (_id, _members, _size, _digest, _row) with ``_times`` for each row; and the sources with their targets.

    A row counts once for the size of every source that holds it.
    """
    patterns = saved(sized.groupBy("_members").agg(F.sum("_size").alias("_words")), "patterns")
    sources = saved(source_targets(patterns, weights), "targets")
    given = saved(pattern_shares(patterns, sources), "shares")
    return _times(sized, given, seed), sources


def _times(sized: DataFrame, given: DataFrame, seed: int) -> DataFrame:
    """How often each row is taken: whole rounds, and once more up to its pattern's rest in seeded order.

    A document that does not fit ends the first filling; the second goes on behind it with those that fit.
    """
    # Rows without a key are drawn by their text; else all of them would have one place in the order.
    number = seeded_number(F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null|"), F.col("_digest").cast("string"))), seed)
    high = F.shiftright("_n", 60 - _RANGE_BITS)
    low = F.shiftright("_n", 60 - 2 * _RANGE_BITS).bitwiseAND((1 << _RANGE_BITS) - 1)
    drawn = sized.join(given, "_members").withColumn("_n", number)
    picked = drawn.withColumns({"_high": high, "_low": low, "_more": F.lit(0)})
    for _ in range(2):
        picked = saved(_filled(picked, given), "picked")
    # What is missing then goes to the one further document whose size comes nearest to it.
    gaps = saved(_gaps(picked, given), "gaps")
    far = F.abs(F.col("_size") - F.col("_gap"))
    nearest = saved(
        picked.filter("_more = 0")
        .join(gaps, "_members")
        .filter(far < F.col("_gap"))
        .groupBy("_members")
        .agg(F.min(F.struct(far.alias("_far"), "_n", "_size", "_id", "_digest", F.col("_row").alias("_nearest"))).alias("_s"))
        .select("_members", "_s._nearest"),
        "nearest",
    )
    chosen = (F.col("_more") == 0) & (F.col("_row") == F.col("_nearest"))
    return picked.join(nearest, "_members", "left").select(
        *sized.columns, (F.col("_whole") + F.col("_more") + F.coalesce(chosen, F.lit(False)).cast("int")).alias("_times")
    )


def _gaps(picked: DataFrame, given: DataFrame) -> DataFrame:
    """Words that each pattern still lacks, where it lacks any."""
    taken = picked.groupBy("_members").agg(F.sum(F.col("_size") * F.col("_more")).alias("_taken"))
    gaps = given.join(taken, "_members").select("_members", (F.col("_rest") - F.col("_taken")).alias("_gap"))
    return gaps.filter("_gap > 0")


def _filled(picked: DataFrame, given: DataFrame) -> DataFrame:
    """``picked`` with further rows marked, in seeded order among those that fit, as long as the gap lasts."""
    columns = picked.columns
    asked = picked.join(saved(_gaps(picked, given), "gaps"), "_members", "left")
    fits = F.coalesce((F.col("_more") == 0) & (F.col("_size") <= F.col("_gap")), F.lit(False))
    open_ = asked.filter(fits)
    # The range where the gap is filled, then the part of that range; each table has a row per pattern.
    first = saved(_crossing(open_, "_high", F.col("_gap")), "ranges")
    inside = open_.join(first, ["_members", "_high"])
    second = saved(_crossing(inside, "_low", F.col("_gap") - F.col("_before")), "ranges")
    ends = first.select("_members", F.col("_high").alias("_high_end"), F.col("_before").alias("_before_high"))
    part = second.select("_members", F.col("_low").alias("_low_end"), F.col("_before").alias("_before_low"))
    ends = saved(ends.join(part, "_members"), "ends")
    marked = asked.withColumn("_fits", fits).join(ends, "_members", "left")
    here = F.col("_fits") & (F.col("_high") == F.col("_high_end")) & (F.col("_low") == F.col("_low_end"))
    order = Window.partitionBy("_members").orderBy("_n", "_size", "_id", "_digest", "_row").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_size").over(order) + F.col("_before_high") + F.col("_before_low")
    last = marked.filter(here).withColumn("_more", (total <= F.col("_gap")).cast("int"))
    sooner = (F.col("_high") < F.col("_high_end")) | (
        (F.col("_high") == F.col("_high_end")) & (F.col("_low") < F.col("_low_end"))
    )
    # Without an end all that fit are taken.
    more = F.when(F.col("_fits"), F.coalesce(sooner, F.lit(True)).cast("int")).otherwise(F.col("_more"))
    others = marked.filter(~F.coalesce(here, F.lit(False))).withColumn("_more", more)
    return last.select(*columns).unionByName(others.select(*columns))


def _crossing(rows: DataFrame, part: str, rest: Column) -> DataFrame:
    """For each pattern the range in which ``rest`` words are reached, and the words ``_before`` it."""
    sums = rows.groupBy("_members", part).agg(F.sum("_size").alias("_sum"), F.first(rest).alias("_wanted"))
    # At most 4096 rows per pattern.
    upto = F.sum("_sum").over(Window.partitionBy("_members").orderBy(part))
    sums = sums.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_wanted")) & (F.col("_wanted") > 0))
    return sums.groupBy("_members").agg(F.min(F.struct(part, (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_s")).select(
        "_members", F.col(f"_s.{part}").alias(part), F.col("_s._before").alias("_before")
    )


def _sized(df: DataFrame, key: str, text: str, members: Column, row: Column) -> DataFrame:
    """A narrow row for each row, written so that the number ``row`` gives it stays."""
    digest = F.xxhash64(F.coalesce(col(text), F.lit("")))
    none = F.array(F.lit(None).cast("string"))
    members = F.when(F.size(members) > 0, members).otherwise(none)
    columns = [col(key).alias("_id"), members.alias("_members"), word_count(col(text)).alias("_size"), digest.alias("_digest")]
    return saved(df.select(*columns, row.alias("_row")), "sizes")


def mix_report(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11,
    weights: Sequence[int] | None = None,
) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target`` of its source and ``taken`` words, for every row."""
    sized = _sized(df, key, text, F.array(col(source).cast("string")), F.monotonically_increasing_id())
    planned, sources = plan_mix(sized, weights, seed)
    facts = saved(
        sources.select(F.array("_name").alias("_members"), F.col("_size").alias("source_size"), F.col("_target").alias("target")), "facts"
    )
    return planned.join(facts, "_members", "left").select(
        F.col("_id").alias(key),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * F.col("_times")).alias("taken"),
    )


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11,
    weights: Sequence[int] | None = None,
) -> DataFrame:
    """The rows as often as the mix takes them (0 to 3 times), their columns as they are.

    ``source`` is a string column, or an array of strings for documents that several sources hold.
    Rows that share a key, or have none, are decided each for itself: the rows are written with a number that the plan carries.
    """
    own, count, copy = (free_name(df, n) for n in ("_row", "_times", "_copy"))
    rows = saved(df.withColumn(own, F.monotonically_increasing_id()), "rows")
    kind = dict(df.dtypes)[source]
    members = F.sort_array(F.array_distinct(col(source))) if kind.startswith("array") else F.array(col(source).cast("string"))
    planned, _ = plan_mix(_sized(rows, key, text, members, col(own)), weights, seed)
    times = planned.filter("_times > 0").select(F.col("_row").alias(own), F.col("_times").alias(count))
    joined = rows.join(times, own)
    copies = F.explode(F.sequence(F.lit(1), F.col(count))).alias(copy)
    return joined.select(*[col(c) for c in df.columns], copies).drop(copy)
