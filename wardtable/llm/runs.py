"""Periodic runs of words, found on a harmonic grid with longest common extensions.

A run of period q that holds ``TIMES`` periods or more has a stretch of at least (TIMES - 1) * q places whose word comes
again q places later, so places (TIMES - 1) * q apart meet every one; over all periods that is a harmonic sum of places.
At a place of the grid whose word does come again, the common extension to the right and to the left gives the
whole stretch, and so the run. Of runs with the same ends the smallest period is the run's own: the others are its multiples.

Extensions are answered by a difference cover: suffixes are sorted at the places alone whose number modulo 7
is 0, 1 or 3, by doubling; neighbours' common prefixes go into a sparse table. Two places reach sampled ones after
the same step of at most six words, which are compared one by one; a minimum in the table says the rest.
The texts of a slice lie in one array with a word of its own between them, so no run crosses texts.

Null and empty texts have no words and no runs. Very long texts are taken whole: work per word grows with the logarithm of the length. Repeated
rows are taken each for itself; other columns are kept or left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from wardtable.llm.common import col, map_rows

#: Periods that a run holds at least, and words.
TIMES, LEAST = 4, 6
#: Words that are searched together, if texts are shorter.
TOGETHER = 100_000
#: Residues modulo 7 whose differences are all residues.
CYCLE, COVER = 7, (0, 1, 3)
#: Grid places that are looked at in one go.
GRID = 1 << 20


def _steps() -> np.ndarray:
    """Smallest step after which places of two residues are both in the cover."""
    table = np.zeros((CYCLE, CYCLE), dtype="i8")
    for a in range(CYCLE):
        for b in range(CYCLE):
            table[a, b] = next(d for d in range(CYCLE) if (a + d) % CYCLE in COVER and (b + d) % CYCLE in COVER)
    return table


STEPS = _steps()
#: Number of a cover residue among them.
NTH = np.array([COVER.index(r) if r in COVER else -1 for r in range(CYCLE)])


def _dense(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """Ranks from 1 on in the place of each row, equal rows alike; ``differs`` is by sorted neighbours."""
    ranks = np.empty(len(order), dtype="i8")
    ranks[order] = np.concatenate([[1], 1 + np.cumsum(differs)])
    return ranks


class Extensions:
    """Longest common prefixes of suffixes of an array of word numbers, the last of which occurs once."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        cycles = -(-n // CYCLE)
        self.words = np.concatenate([words + 1, np.zeros(2 * CYCLE + cycles * CYCLE - n, dtype="i8")])
        places = (np.arange(cycles)[:, None] * CYCLE + np.array(COVER)).ravel()
        width = max(1, int(self.words.max()).bit_length())
        together = max(1, 62 // width)
        columns = []
        for start in range(0, CYCLE, together):
            column = np.zeros(len(places), dtype="i8")
            for k in range(start, min(start + together, CYCLE)):
                column = column << width | self.words[places + k]
            columns.append(column)
        order = np.lexsort(columns[::-1])
        differs = np.zeros(len(places) - 1, dtype=bool)
        for column in columns:
            differs |= column[order[1:]] != column[order[:-1]]
        levels, shift = [_dense(order, differs)], len(COVER)
        while len(places) > 1 and not differs.all() and shift < len(places):
            ranks = levels[-1]
            later = np.concatenate([ranks[shift:], np.zeros(shift, dtype="i8")])
            pair = ranks * (len(places) + 1) + later
            order = np.argsort(pair, kind="stable")
            differs = pair[order[1:]] != pair[order[:-1]]
            levels.append(_dense(order, differs))
            shift *= 2
        self.rank = np.empty(len(places), dtype="i8")
        self.rank[order] = np.arange(len(places))
        self.table = self._minima(self._neighbours(order, places, levels))

    def _neighbours(self, order: np.ndarray, places: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sampled suffix and the next in order: whole windows by rank, from wide to narrow, then words."""
        a, b = order[:-1], order[1:]
        done = np.zeros(len(a), dtype="i8")  # sampled places passed
        for k in range(len(levels) - 1, -1, -1):
            ranks = np.concatenate([levels[k], [-1, -2]])  # beyond the end nothing is equal
            x, y = np.minimum(a + done, len(places)), np.minimum(b + done, len(places))
            y = np.where((x == len(places)) & (y == len(places)), len(places) + 1, y)
            done += np.where(ranks[x] == ranks[y], len(COVER) << k, 0)
        common = done // len(COVER) * CYCLE
        for _ in range(CYCLE - 1):
            common += self._equal(places[a] + common, places[b] + common)
        return common

    def _equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words are equal; the mark behind the last word equals nothing."""
        x = self.words[np.minimum(i, len(self.words) - 1)]
        return (x == self.words[np.minimum(j, len(self.words) - 1)]) & (x > 0)

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at different places ``i`` and ``j``."""
        step = STEPS[i % CYCLE, j % CYCLE]
        found = np.zeros(len(i), dtype="i8")
        alive = np.ones(len(i), dtype=bool)
        for k in range(CYCLE - 1):
            alive &= (k >= step) | self._equal(i + k, j + k)
            found += alive & (k < step)
        rows = np.flatnonzero(alive)
        if len(rows):
            x, y = i[rows] + step[rows], j[rows] + step[rows]
            within = np.maximum(x, y) < len(self.rank) // len(COVER) * CYCLE
            rows, x, y = rows[within], x[within], y[within]
            a = self.rank[x // CYCLE * len(COVER) + NTH[x % CYCLE]]
            b = self.rank[y // CYCLE * len(COVER) + NTH[y % CYCLE]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype("f8"))[1] - 1
            least = np.empty(len(rows), dtype="i8")
            for k in np.unique(level).tolist():
                at = level == k
                least[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
            found[rows] += least
        return found


def _grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) for periods up to ``longest``, places of each period TIMES - 1 periods apart."""
    periods = np.arange(1, longest + 1)
    counts = np.maximum(0, -(-(n - periods) // ((TIMES - 1) * periods)))
    ends = np.cumsum(counts)
    start = 0
    while start < longest:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + GRID)))
        q, c = periods[start:stop], counts[start:stop]
        period = np.repeat(q, c)
        nth = np.arange(len(period)) - np.repeat(np.cumsum(c) - c, c)
        yield nth * (TIMES - 1) * period, period
        start = stop


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs by start and period; ``words`` begins and ends with a word that occurs once.

    ``longest`` is the number of words that no run exceeds.
    """
    n = len(words)
    found = []
    right = left = None
    for place, period in _grid(n, longest // TIMES):
        again = words[place] == words[place + period]
        place, period = place[again], period[again]
        if not len(place):
            continue
        if right is None:
            right, left = Extensions(words), Extensions(words[::-1])
        after = right.common(place, place + period)
        before = left.common(n - place, n - place - period)  # up to the place before
        long = after + before >= np.maximum((TIMES - 1) * period, LEAST - period)
        place, period, after, before = place[long], period[long], after[long], before[long]
        found.append(np.column_stack([place - before, place + period + after, period]))
    if not found:
        return np.zeros((0, 3), dtype="i8")
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period: the smallest period of the same ends comes first
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(runs, kept) of each list of words: rows (start, length, period), and which words stay when runs collapse to one period."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    group: list[list[bytes]] = []
    size = 0
    for words in texts:
        group.append(words)
        size += len(words)
        if size >= TOGETHER:
            out += _group_runs(group)
            group, size = [], 0
    return out + _group_runs(group)


def _group_runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    known: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], dtype="i8")
    starts = np.cumsum(lengths + 1) - lengths  # a mark before the first text and behind each
    array = np.empty(int((lengths + 1).sum()) + 1, dtype="i8")
    for start, words in zip(starts.tolist(), texts, strict=True):
        array[start : start + len(words)] = [known.setdefault(w, len(known)) for w in words]
    marks = np.append(starts - 1, len(array) - 1)
    array[marks] = len(known) + np.arange(len(marks))
    rows = runs_of(array, int(lengths.max(initial=0)))
    change = np.zeros(len(array) + 1, dtype="i8")
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    stays = np.cumsum(change) == 0
    bounds = np.searchsorted(rows[:, 0], np.append(starts, len(array)))
    out = []
    for k, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        mine = rows[bounds[k] : bounds[k + 1]]
        out.append((np.column_stack([mine[:, 0] - start, mine[:, 1] - mine[:, 0], mine[:, 2]]), stays[start : start + length]))
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _joined(words: list[bytes], stays: np.ndarray) -> bytes:
    return b" ".join(words if stays.all() else [w for w, s in zip(words, stays.tolist(), strict=True) if s])


def _named(found: np.ndarray) -> list[dict[str, int]]:
    return [{"start": start, "length": length, "period": period} for start, length, period in found.tolist()]


def collapse_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), ``runs`` (start, length, period in words) and ``collapsed``: the words left when each run keeps one period."""

    def work() -> Callable[..., list[tuple]]:
        def f(texts: list[str | None]) -> list[tuple]:
            cut = [_words(t) for t in texts]
            return [(_named(found), _joined(words, stays).decode()) for words, (found, stays) in zip(cut, find_runs(cut), strict=True)]

        return f

    schema = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return map_rows(df, [col(text)], schema, work, df.columns if keep is None else keep)


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """The words, for one key in ten with a tail that repeats; without a key as they are."""
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + period]
    return words[:a] + (tail * (-(-(n - a) // period)))[: n - a]


def run_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of whole texts with planted tails: their number, the one with the greatest exponent, and digests."""

    def row(words: list[bytes], runs: np.ndarray, stays: np.ndarray) -> tuple:
        listed = runs.tolist()
        told = "".join(f"{s},{length},{q}\n" for s, length, q in listed)
        best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return len(listed), *shown, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(_joined(words, stays)).hexdigest()

    def work() -> Callable[..., list[tuple]]:
        def f(texts: list[str | None], keys: list[int | None]) -> list[tuple]:
            cut = [planted(_words(t), k) for t, k in zip(texts, keys, strict=True)]
            return [row(w, runs, stays) for w, (runs, stays) in zip(cut, find_runs(cut), strict=True)]

        return f

    schema = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return map_rows(df, [col(text), col(key)], schema, work, [key])
