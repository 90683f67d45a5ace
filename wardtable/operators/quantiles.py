"""Exact quantiles of whole columns, with linear interpolation.

The built-in exact ``percentile`` keeps every distinct value in one task. Here a mergeable sketch
brackets each wanted rank, counting proves the bracket right, and the bracket is
narrowed until it holds few enough values to read. Each round is one aggregate
over the column; nothing is sampled, so the result is exact. Columns of every size go this way.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import col

#: Values that all brackets together may hold when they are read.
READ_LIMIT = 100_000
SKETCH = 10_000


@dataclass
class _Target:
    """One wanted pair of neighbouring ranks and the bracket that holds them."""

    column: str
    share: float
    rank: int
    weight: float
    low: float
    high: float
    below: int = 0
    inside: int = 0
    value: float | None = None


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    read_limit: int = READ_LIMIT,
) -> dict[str, list[float | None]]:
    """Quantiles per column, missing values left out; an empty column gives nulls.

    A first pass takes a sketch of every column, a second one counts the distinct values inside the brackets around the
    wanted ranks and the rows below each. Where these values are too many to read, brackets are narrowed pass by pass.

    The wanted columns are kept (memory, then disk) while the few passes run, so the
    input is computed once; a lost copy is computed again from its source.
    """
    columns = list(columns)
    if not columns:
        return {}
    values = df.select(
        *[F.nanvl(col(c).cast("double"), F.lit(None)).alias(f"v{i}") for i, c in enumerate(columns)]
    ).persist()
    try:
        return _quantiles(values, columns, shares, read_limit)
    finally:
        values.unpersist()


def _quantiles(
    values: DataFrame, columns: list[str], shares: Sequence[float], read_limit: int
) -> dict[str, list[float | None]]:
    inner = sorted({s for s in shares if 0 < s < 1})
    margin = 2.5 / SKETCH
    ends = [min(1.0, max(0.0, s + m)) for s in inner for m in (-margin, margin)]
    sketches = [F.percentile_approx(f"v{i}", ends, SKETCH).alias(f"q{i}") for i in range(len(columns))] if inner else []
    first = values.agg(
        *sketches,
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.min(f"v{i}").alias(f"lo{i}") for i in range(len(columns))],
        *[F.max(f"v{i}").alias(f"hi{i}") for i in range(len(columns))],
    ).first()
    counts = [first[f"n{i}"] for i in range(len(columns))]
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}

    targets = []
    for i, n in enumerate(counts):
        if n:
            for s in shares:
                place = s * (n - 1)
                rank = min(int(math.floor(place)), max(n - 2, 0))
                target = _Target(f"v{i}", s, rank, place - rank, first[f"lo{i}"], first[f"hi{i}"], 0, n)
                if s in (0, 1):
                    target.value = target.high if s else target.low
                targets.append(target)
    if inner and targets:
        _read_counts(values, targets, {f"v{i}": first[f"q{i}"] for i, n in enumerate(counts) if n}, read_limit)
    _narrow(values, targets, max(1, read_limit // max(1, len(targets))))
    done = iter(targets)
    for i, n in enumerate(counts):
        if n:
            out[columns[i]] = [next(done).value for _ in shares]
    return out


def _read_counts(values: DataFrame, targets: list[_Target], ends: dict[str, list[float]], read_limit: int) -> None:
    """Settles targets from how often each value inside the sketch's brackets occurs; a missed bracket settles nothing.

    All rows between two brackets count as one value, so few groups leave a task where values repeat. Nothing is settled
    when more than ``read_limit`` values lie inside the brackets.
    """
    cells, brackets = [], {}
    for name, cuts in ends.items():
        spans: list[list[float]] = []
        for low, high in zip(cuts[::2], cuts[1::2]):  # in order; those that touch are one
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(high, spans[-1][1])
            else:
                spans.append([low, high])
        brackets[name] = spans
        c = F.col(name)
        # Even places are the gaps around the brackets, odd ones the brackets.
        place, inside = F.lit(2 * len(spans)), F.lit(False)
        for k in reversed(range(len(spans))):
            low, high = map(F.lit, spans[k])
            place = F.when(c < low, F.lit(2 * k)).when(c <= high, F.lit(2 * k + 1)).otherwise(place)
            inside = inside | ((c >= low) & (c <= high))
        cells.append(F.when(c.isNotNull(), F.struct(F.lit(name).alias("c"), place.alias("place"), F.when(inside, c).alias("v"))))
    groups = values.select(F.explode(F.array(*cells)).alias("e")).filter("e is not null").groupBy("e.c", "e.place", "e.v").count()
    most = read_limit + sum(len(s) + 1 for s in brackets.values())
    found = groups.limit(most + 1).collect()
    if len(found) > most:
        return
    by_column: dict[str, list] = {}
    for r in found:
        by_column.setdefault(r["c"], []).append((r["place"], r["v"], r["count"]))
    for name, rows in by_column.items():
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        upto = list(itertools.accumulate(r[2] for r in rows))
        for t in targets:
            if t.column == name and t.value is None:
                pair = [rows[bisect.bisect_right(upto, at)][1] for at in (t.rank, min(t.rank + 1, upto[-1] - 1))]
                if None not in pair:
                    t.value = pair[0] + (pair[1] - pair[0]) * t.weight


def _narrow(values: DataFrame, targets: list[_Target], read_limit: int) -> None:
    for t in targets:
        if t.value is None and t.low == t.high:
            t.value = t.low
    open_ = [t for t in targets if t.value is None]
    while True:
        wide = [t for t in open_ if t.value is None and t.inside > read_limit and t.low < t.high]
        if not wide:
            break
        # Targets that share a bracket (all of a column's, at first) share one sketch.
        shared: dict[tuple, list[float]] = {}
        places = []
        for t in wide:
            here = (t.rank - t.below) / t.inside
            margin = 2.0 / SKETCH
            ends = shared.setdefault((t.column, t.low, t.high), [])
            places.append(((t.column, t.low, t.high), len(ends)))
            ends += [max(0.0, here - margin), min(1.0, here + margin + 2.0 / t.inside)]
        brackets = list(shared)
        found = values.agg(
            *[
                F.percentile_approx(
                    F.when((F.col(c) >= low) & (F.col(c) <= high), F.col(c)), shared[(c, low, high)], SKETCH
                ).alias(f"e{k}")
                for k, (c, low, high) in enumerate(brackets)
            ]
        ).first()
        ends_of = {b: found[f"e{k}"] for k, b in enumerate(brackets)}
        tries = [(ends_of[b][i], ends_of[b][i + 1]) for b, i in places]
        checks = []
        for k, (t, (lo, hi)) in enumerate(zip(wide, tries)):
            c = F.col(t.column)
            checks += [
                F.count_if(c < lo).alias(f"b{k}"),
                F.count_if((c >= lo) & (c <= hi)).alias(f"n{k}"),
            ]
        counted = values.agg(*checks).first()
        for k, (t, (lo, hi)) in enumerate(zip(wide, tries)):
            below, inside = counted[f"b{k}"], counted[f"n{k}"]
            holds = below <= t.rank and t.rank + 1 < below + inside
            if holds and inside < t.inside:
                t.low, t.high, t.below, t.inside = lo, hi, below, inside
                continue
            # The sketch missed or cannot cut further: halve the value range instead.
            _halve(values, t)
    for t in open_:
        if t.value is None and t.low == t.high:
            t.value = t.low
    rest = [t for t in open_ if t.value is None]
    if not rest:
        return
    # Brackets hold at most `read_limit` values each, and all together no more than the caller allows.
    brackets = list(dict.fromkeys((t.column, t.low, t.high) for t in rest))
    row = values.agg(
        *[
            F.sort_array(F.collect_list(F.when((F.col(c) >= low) & (F.col(c) <= high), F.col(c)))).alias(f"l{k}")
            for k, (c, low, high) in enumerate(brackets)
        ]
    ).first()
    lists = {b: row[f"l{k}"] for k, b in enumerate(brackets)}
    for t in rest:
        found = lists[t.column, t.low, t.high]
        at = t.rank - t.below
        a = found[at]
        b = found[min(at + 1, len(found) - 1)]
        t.value = a + (b - a) * t.weight


def _halve(values: DataFrame, t: _Target) -> None:
    """Shrink one bracket by value: keeps both wanted ranks inside or settles them."""
    c = F.col(t.column)
    mid = t.low + (t.high - t.low) / 2
    if mid >= t.high:  # neighbouring doubles
        mid = t.low
    row = values.agg(
        F.count_if(c <= mid).alias("upto"),
        F.max(F.when((c <= mid) & (c >= t.low), c)).alias("left"),
        F.min(F.when((c > mid) & (c <= t.high), c)).alias("right"),
        F.count_if((c >= t.low) & (c <= mid)).alias("n_left"),
    ).first()
    upto = row["upto"]
    if t.rank + 1 < upto:
        t.high, t.inside = row["left"], row["n_left"]
    elif t.rank >= upto:
        t.inside -= row["n_left"]
        t.low, t.below = row["right"], upto
    else:
        t.value = row["left"] + (row["right"] - row["left"]) * t.weight
        t.low = t.high = row["left"]
    if t.low == t.high and t.value is None:
        t.value = t.low
