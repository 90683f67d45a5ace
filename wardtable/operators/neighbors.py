"""Exact nearest neighbours over a distributed tree of donor cells.

Donors are split into cells by medians: each pass samples a bounded number of rows of every cell that is
still too large, builds a tree of at most ``FAN`` leaves from them and deals the cell's rows out to its leaves,
until no cell holds more than ``block_rows`` rows. So the number of cells grows with the donors, and trees and
boxes are tables that are never whole on the driver or in a task. Cells whose rows are all alike stay whole and are cut into
blocks by hash.

A query row goes down the trees to its own cell first and takes the k-th distance there. Then it goes down the levels of
bounding boxes and keeps the cells that come as near as that distance; no other can hold a neighbour. Each pair of blocks
hands on at most k rows per query row. Nothing is sampled, capped or approximated in the
result: samples decide where cells are cut, and bounds only skip work that cannot matter.

Within a pair of blocks euclidean distances come from matrix products first, with a bound on their rounding; the rows that
they leave in question are measured coordinate by coordinate, and only these distances count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardtable.functions.expressions import col
from wardtable.session import new_folder

BLOCK_ROWS = 4096
#: Rows of a block where rows have more than ``WIDE`` coordinates: boxes prune little there, and rows meet few, large blocks.
WIDE, WIDE_BLOCK_ROWS = 16, 16_384
#: Leaves of one tree, and rows of a cell that it is built from (about).
FAN, SAMPLE_ROWS = 1024, 32_768
#: Rows that meet their cell's numbers in one task.
STREAM_ROWS = 20_000
#: Passes after which cell numbers would leave 64 bits; 1024 ** 6 cells.
PASSES = 6
_WORK = 2_000_000  # numbers in one temporary distance array
#: Rows that a step down the boxes hands on at a time; where boxes prune little, a query row has one for every box.
PAIRS = 200_000


def _matrix(series: pd.Series, width: int) -> np.ndarray:
    if not len(series):
        return np.empty((0, width))
    return np.array([np.asarray(v, dtype="float64") for v in series], dtype="float64")


def _saved(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "neighbors")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Pairwise distances; coordinates missing on either side are left out.

    Euclidean distances are stretched by the share of coordinates used; rows that share
    none have no distance.
    """
    return _lengths(x[:, None, :] - y[None, :, :], metric)


def _lengths(diff: np.ndarray, metric: str) -> np.ndarray:
    """Distances from the differences of coordinates, which lie along the last axis."""
    diff = np.abs(diff)
    shared = ~np.isnan(diff)
    used = shared.sum(axis=-1)
    diff = np.where(shared, diff, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "manhattan":
            out = diff.sum(axis=-1) * (diff.shape[-1] / used)
        else:
            out = np.sqrt((diff * diff).sum(axis=-1) * (diff.shape[-1] / used))
    out[used == 0] = np.nan
    return out


def _products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Squared euclidean distances by matrix products, infinite without a shared coordinate, and for each row of ``x`` how far off they are at most.

    None where a number is infinite, or too large to be squared and added up.
    """
    width = x.shape[1]
    sides = [(~np.isnan(m), np.where(np.isnan(m), 0.0, m)) for m in (x, y)]
    (has_x, x), (has_y, y) = sides
    if max((np.abs(m).max() for m in (x, y) if m.size), default=0.0) > 1e150:
        return None
    xx, yy = x * x, y * y
    if has_x.all() and has_y.all():
        size, stretch = xx.sum(axis=1).max(initial=0.0) + yy.sum(axis=1).max(initial=0.0), 1.0
        out = x @ y.T
        out *= -2.0
        out += xx.sum(axis=1)[:, None]
        out += yy.sum(axis=1)
    else:
        has_x, has_y = has_x.astype(float), has_y.astype(float)
        used = has_x @ has_y.T
        out = xx @ has_y.T + has_x @ yy.T
        size = out.max(initial=0.0)
        out -= 2.0 * (x @ y.T)
        stretch = width
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(used > 0, out * (width / used), np.inf)
    # Sums of width products of numbers whose squares add up to at most size, in any order, and their stretching.
    return out, np.full(len(x), 8.0 * (width + 4) * np.finfo(float).eps * size * stretch)


def closest(x: np.ndarray, y: np.ndarray, k: int, metric: str, limit: np.ndarray, cases: Sequence[tuple[np.ndarray, np.ndarray]]):
    """For each case, the numbers of its rows of ``x`` and the rows of ``y`` it may take: row, row of ``y`` and distance of the k nearest.

    Equal distances go by the order of ``y``. Rows farther than the ``limit`` of a row of ``x`` may be left out.
    """
    found = _products(x, y) if metric == "euclidean" else None
    exact = None if found else _distances(x, y, metric)
    for rows, allowed in cases:
        if exact is not None:
            dist = np.where(allowed & ~np.isnan(exact[rows]), exact[rows], np.inf)
            at = np.argsort(dist, axis=1, kind="stable")[:, :k]
            close = np.take_along_axis(dist, at, axis=1)
            ok = np.isfinite(close)
            yield rows[np.nonzero(ok)[0]], at[ok], close[ok]
            continue
        near = np.where(allowed, found[0][rows], np.inf) if not allowed.all() else found[0][rows]
        off = found[1][rows]
        bound = np.square(limit[rows]) * (1 + 1e-9) + off
        free = np.flatnonzero(~np.isfinite(bound))
        if len(free) and near.shape[1] > k:
            bound[free] = np.partition(near[free], k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 2 * off[free]
        row, at = np.nonzero((near <= bound[:, None]) & np.isfinite(near))
        dist = np.empty(len(row))
        for part in _chunks(len(row), x.shape[1]):
            dist[part] = _lengths(x[rows[row[part]]] - y[at[part]], metric)
        order = np.lexsort((at, dist, row))
        row, at, dist = row[order], at[order], dist[order]
        first = np.searchsorted(row, row)
        ok = (np.arange(len(row)) - first < k) & np.isfinite(dist)
        yield rows[row[ok]], at[ok], dist[ok]


def _first_alike(y: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that have fewer than k rows like them before them: no other can be among the k nearest."""
    if not y.size:
        return np.arange(len(y))
    _, kind = np.unique(np.ascontiguousarray(y + 0.0).view(f"V{y.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    rank = np.arange(len(y)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[rank < k])


def _chunks(n: int, per_row: int) -> Iterator[slice]:
    step = max(1, _WORK // max(1, per_row))
    for start in range(0, n, step):
        yield slice(start, start + step)


# --- the tree ---------------------------------------------------------------


def split_tree(y: np.ndarray, depth: int, weights: np.ndarray | float = 1.0) -> np.ndarray:
    """Axis (or -1) and cut of each of the 2 ** depth - 1 inner nodes, in heap order, one after the other.

    A node is cut at the median of its widest axis, widths times ``weights``; larger values go right, missing ones left.
    """
    nodes = (1 << depth) - 1
    axis, cut = np.full(nodes, -1.0), np.zeros(nodes)
    members = {0: np.arange(len(y))}
    for node in range(nodes):
        rows = members.pop(node, None)
        if rows is None or len(rows) < 2:
            continue
        part = y[rows]
        filled = ~np.isnan(part)
        low, high = np.where(filled, part, np.inf).min(axis=0), np.where(filled, part, -np.inf).max(axis=0)
        wide = np.where(high > low, high - low, 0.0) * weights
        best = int(np.argmax(wide))
        if not wide[best] > 0:
            continue
        values = np.sort(part[filled[:, best], best])
        at = values[(len(values) - 1) // 2]
        if at == values[-1]:
            at = values[np.searchsorted(values, at) - 1]
        axis[node], cut[node] = best, at
        right = part[:, best] > at  # false for missing values
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return np.concatenate([axis, cut])


def leaf_of(tree: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leaf of each row; below a node without a cut all go left."""
    nodes = len(tree) // 2
    axis, cut = tree[:nodes].astype("int64"), tree[nodes:]
    at = np.zeros(len(y), dtype="int64")
    while nodes:
        a = axis[at]
        right = (a >= 0) & (y[np.arange(len(y)), np.maximum(a, 0)] > cut[at])
        at = 2 * at + 1 + right
        nodes >>= 1
    return at - len(axis)


def _with_cells(
    cells: DataFrame, rows: DataFrame, key: str, work: Callable[[list[np.ndarray], pd.DataFrame], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """``work(numbers, rows)`` for the rows of each ``_cell`` and the ``_data`` arrays that ``cells`` has for it.

    Both are dealt by cell, large ones in several parts, and stream by in order, the numbers first: a task holds one
    cell's numbers and one batch. Rows of cells without numbers are left out.
    """
    sizes = rows.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / STREAM_ROWS).cast("int").alias("_parts"))
    names = [c for c in rows.columns if c != "_cell"]
    heads = cells.join(sizes, "_cell").select(
        "_cell", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), "_data",
        *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in names],
    )
    dealt = rows.join(sizes, "_cell").select(
        "_cell", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_kind"),
        F.lit(None).cast("array<double>").alias("_data"), *names,
    )
    order = ["_cell", "_part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, numbers = None, []
        for pdf in batches:
            for place, part in pdf.groupby(order, sort=False):
                if place != mine:
                    mine, numbers = place, []
                numbers += [np.asarray(v, dtype="float64") for v in part["_data"][part["_kind"] == 0]]
                told = part[part["_kind"] == 1]
                if len(told) and numbers:
                    for made in work(numbers, told.drop(columns=["_part", "_kind", "_data"])):
                        # Text that shares Arrow buffers with its batch can't go back as it is.
                        yield made.astype({c: object for c, t in made.dtypes.items() if isinstance(t, pd.StringDtype)})

    return heads.unionByName(dealt).repartition(*order).sortWithinPartitions(*order, "_kind").mapInPandas(run, schema)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def _down(rows: DataFrame, trees: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """The rows with the number of their cell one level lower: cells without a tree have one child, number 0."""

    def work(numbers: list[np.ndarray], part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield part.assign(_cell=part["_cell"] * FAN + leaf_of(numbers[0], _matrix(part[vector], width)))[names]

    names = rows.columns
    split = _with_cells(trees, rows, key, work, _schema(rows))
    others = rows.join(trees.select("_cell"), "_cell", "left_anti")
    return split.unionByName(others.select(*[(F.col(c) * FAN).alias(c) if c == "_cell" else c for c in names]))


def _grow(donors: DataFrame, width: int, block_rows: int, weights: np.ndarray | float = 1.0) -> tuple[DataFrame, list[DataFrame]]:
    """Donors with their ``_cell``, and the table of trees (``_cell``, ``_data``) of each pass."""
    rows = donors.withColumn("_cell", F.lit(0).cast("bigint"))
    trees: list[DataFrame] = []
    whole = None  # cells that have no cut
    while len(trees) < PASSES:
        sizes = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
        if whole is not None:
            sizes = sizes.join(whole, "_cell", "left_anti")
        sizes = _saved(sizes)
        if sizes.isEmpty():
            break
        share = F.pmod(F.xxhash64("_d", F.lit(len(trees))), F.lit(1 << 30)) < F.lit(float(1 << 30)) * SAMPLE_ROWS / F.col("_n")
        picked = rows.join(sizes, "_cell").filter(share).select("_cell", "_n", "_y")

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            wanted = 2 * pdf["_n"].iloc[0] / block_rows
            depth = int(np.clip(np.ceil(np.log2(wanted)), 1, np.log2(FAN)))
            return pd.DataFrame({"_cell": pdf["_cell"].iloc[:1], "_data": [split_tree(_matrix(pdf["_y"], width), depth, weights)]})

        found = _saved(picked.groupBy("_cell").applyInPandas(build, "_cell bigint, _data array<double>"))
        uncut = found.filter(F.get("_data", F.lit(0)) < 0).select((F.col("_cell") * FAN).alias("_cell"))
        whole = uncut if whole is None else uncut.unionByName(whole.select((F.col("_cell") * FAN).alias("_cell")))
        trees.append(found)
        rows = _saved(_down(rows, found, "_d", "_y", width))
    return rows, trees


def _boxes(rows: DataFrame, width: int, levels: int) -> list[DataFrame]:
    """For each level, top first: ``_cell`` of the parent and ``_data``, a child's number in it and its box (low, high, holes)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            cell = pdf["_cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            y = _matrix(pdf["_y"], width)[order]
            has = ~np.isnan(y)
            cells, starts = np.unique(cell[order], return_index=True)
            low = np.minimum.reduceat(np.where(has, y, np.inf), starts)
            high = np.maximum.reduceat(np.where(has, y, -np.inf), starts)
            holes = np.logical_or.reduceat(~has, starts).astype(float)
            yield pd.DataFrame(
                {"_cell": np.repeat(cells, width), "_axis": np.tile(np.arange(width), len(cells)), "_low": low.ravel(), "_high": high.ravel(), "_holes": holes.ravel()}
            )

    box = [F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_holes").alias("_holes")]
    long = rows.select("_cell", "_y").mapInPandas(partial, "_cell bigint, _axis int, _low double, _high double, _holes double")
    long = _saved(long.groupBy("_cell", "_axis").agg(*box))
    out = []
    for _ in range(levels):
        sides = [F.sort_array(F.collect_list(F.struct("_axis", F.col(c).alias("_side")))) for c in ("_low", "_high", "_holes")]
        sides = [F.transform(s, lambda p: p["_side"]) for s in sides]
        child = F.array((F.col("_cell") % FAN).cast("double"))
        data = long.groupBy("_cell").agg(F.concat(*sides).alias("_box"))
        out.insert(0, data.select(F.expr(f"_cell div {FAN}").alias("_cell"), F.concat(child, "_box").alias("_data")))
        long = long.groupBy(F.expr(f"_cell div {FAN}").alias("_cell"), "_axis").agg(*box)
    return out


def box_distances(numbers: list[np.ndarray], x: np.ndarray, metric: str) -> np.ndarray:
    """No row of a box is nearer than this to a query row: shape (rows of x, boxes). Squares if the metric is euclidean."""
    width = x.shape[1]
    low, high, holes = (np.stack(numbers)[:, 1 + k * width : 1 + (k + 1) * width] for k in range(3))
    out = np.empty((len(x), len(numbers)))
    for part in _chunks(len(x), len(low)):
        q = x[part]
        has = ~np.isnan(q)
        sums = np.zeros((len(q), len(low)))
        for i in range(width):
            with np.errstate(invalid="ignore"):
                near = np.maximum(np.maximum(low[:, i] - q[:, i, None], q[:, i, None] - high[:, i]), 0.0)
            near[~has[:, i]] = 0.0
            near[:, holes[:, i] != 0] = 0.0
            sums += near if metric == "manhattan" else near * near
        out[part] = sums * (width / np.maximum(has.sum(axis=1), 1))[:, None]
    return out


# --- the search -------------------------------------------------------------


def _compared(
    asked: DataFrame, rows: DataFrame, width: int, k: int, metric: str, for_gaps: bool, block_rows: int
) -> DataFrame:
    """At most k rows for each query row, gap and block, none farther than needed for its ``_bound``: ``_q, _gap, _d, _v, _distance``."""

    def compare(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(d):
            d = d.sort_values("_d", kind="stable")
            x, y, limit = _matrix(q["_x"], width), _matrix(d["_y"], width), q["_bound"].to_numpy(dtype="f8")
            few = _first_alike(y, k)
            y, ids, values, names = y[few], d["_d"].to_numpy()[few], d["_v"].to_numpy()[few], q["_q"].to_numpy()
            missing, have = np.isnan(x), ~np.isnan(y)
            gaps = [g for g in range(width) if missing[:, g].any() and have[:, g].any()] if for_gaps else [-1]
            for part in _chunks(len(x), len(y) if metric == "euclidean" else y.size):
                lines, every = x[part], np.ones(len(y), dtype=bool)
                cases = [(np.flatnonzero(missing[part, g]), have[:, g]) if for_gaps else (np.arange(len(lines)), every) for g in gaps]
                for g, (row, at, dist) in zip(gaps, closest(lines, y, k, metric, limit[part], cases)):
                    said = y[at, g] if for_gaps else values[at]
                    parts.append(pd.DataFrame({"_q": names[part][row], "_gap": g, "_d": ids[at], "_v": said, "_distance": dist}))
        full = [p for p in parts if len(p)]
        none = {"_q": q["_q"].to_numpy()[:0], "_gap": [], "_d": d["_d"].to_numpy()[:0], "_v": [], "_distance": []}
        return pd.concat(full) if full else pd.DataFrame(none)

    blocks = rows.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    chunks = asked.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_chunks"))
    cut = _saved(blocks.join(chunks, "_cell"))
    left = asked.join(cut, "_cell").select(
        "_cell", "_q", "_x", "_bound", F.pmod(F.xxhash64("_q"), F.col("_chunks")).alias("_chunk"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"),
    )
    right = rows.join(cut, "_cell").select(
        "_cell", "_d", "_y", "_v", F.pmod(F.xxhash64("_d"), F.col("_blocks")).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)).alias("_chunk"),
    )
    groups = ["_cell", "_block", "_chunk"]
    schema = f"_q {dict(asked.dtypes)['_q']}, _gap int, _d {dict(rows.dtypes)['_d']}, _v double, _distance double"
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(compare, schema)


def candidate_pairs(queries: DataFrame, boxes: list[DataFrame], width: int, metric: str) -> DataFrame:
    """``_cell, _q, _x, _bound``: cells that come as near to a query row as its ``_bound``, its own one left out."""

    def work(numbers: list[np.ndarray], whole: pd.DataFrame) -> Iterator[pd.DataFrame]:
        step = max(1, PAIRS // len(numbers))
        child_number = np.array([n[0] for n in numbers]).astype("int64")
        for start in range(0, len(whole), step):
            part = whole.iloc[start : start + step]
            x, bound = _matrix(part["_x"], width), part["_bound"].to_numpy()
            lower = box_distances(numbers, x, metric)
            limit = bound if metric == "manhattan" else bound * bound
            row, child = np.nonzero((lower <= limit[:, None] * (1 + 1e-9)) & ~np.isnan(x).all(axis=1)[:, None])
            out = part.iloc[row].copy()
            out["_cell"] = out["_cell"].to_numpy() * FAN + child_number[child]
            yield out

    asked = queries.withColumn("_cell", F.lit(0).cast("bigint"))
    for level in boxes:
        asked = _with_cells(level, asked, "_q", work, _schema(asked))
    return asked.filter(F.col("_cell") != F.col("_own")).select("_cell", "_q", "_x", "_bound")


def _known_shares(queries: DataFrame, width: int) -> np.ndarray:
    """For each coordinate the share of the query rows that have it."""
    values = [F.get("_x", F.lit(i)) for i in range(width)]
    known = queries.agg(*[F.avg((v.isNotNull() & ~F.isnan(v)).cast("double")) for v in values]).first()
    return np.array([v or 0.0 for v in known])


def nearest(
    queries: DataFrame,
    donors: DataFrame,
    width: int,
    k: int,
    metric: str = "euclidean",
    for_gaps: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest donors of each query row, ties by donor key.

    ``queries`` has ``_q, _x`` and ``donors`` ``_d, _y, _v``: keys, coordinates as arrays of
    doubles (missing ones allowed) and a number to carry along. Result:
    ``_q, _gap, _d, _v, _distance``. With ``for_gaps`` each missing coordinate of a query row
    gets its own k donors, among those that have it, and ``_v`` is the donor's value of it;
    distances are computed once for all gaps. Otherwise ``_gap`` is -1.
    """
    block_rows = block_rows or (BLOCK_ROWS if width <= WIDE else WIDE_BLOCK_ROWS)
    # Cuts along a coordinate help the query rows that have it.
    weights = _known_shares(queries, width) if for_gaps else 1.0
    rows, trees = _grow(donors.select("_d", "_y", F.col("_v").cast("double").alias("_v")), width, block_rows, weights)
    own = queries.select("_q", "_x", F.lit(0).cast("bigint").alias("_cell"))
    for found in trees:
        own = _down(own, found, "_q", "_x", width)
    own = _saved(own.withColumn("_bound", F.lit(float("inf"))))
    # At most k rows per query row, gap and block arrive in this window.
    order = Window.partitionBy("_q", "_gap").orderBy("_distance", "_d")

    def first_k(found: DataFrame) -> DataFrame:
        return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)

    close = first_k(_compared(own, rows, width, k, metric, for_gaps, block_rows))
    if not trees:
        return close.drop("_n")
    close = _saved(close)
    # The distance that no neighbour exceeds: the k-th in the own cell, of every gap; none if a gap has fewer.
    full = close.filter(F.col("_n") == k).groupBy("_q").agg(F.max("_distance").alias("_far"), F.count(F.lit(1)).alias("_gaps"))
    wanted = F.size(F.filter("_x", lambda v: v.isNull() | F.isnan(v))) if for_gaps else F.lit(1)
    bound = F.when(F.col("_gaps") == wanted, F.col("_far")).otherwise(F.lit(float("inf")))
    bounded = own.join(full, "_q", "left").select("_q", "_x", bound.alias("_bound"), F.col("_cell").alias("_own"))
    asked = _saved(candidate_pairs(bounded, _boxes(rows, width, len(trees)), width, metric))
    more = _compared(asked, rows, width, k, metric, for_gaps, block_rows)
    return first_k(close.drop("_n").unionByName(more)).drop("_n")


def _weights():
    """1/distance, but donors at distance zero count alone (their own weight is 1)."""
    mine = Window.partitionBy("_q", "_gap")
    touching = F.max((F.col("_distance") == 0).cast("int")).over(mine)
    return F.when(touching == 1, (F.col("_distance") == 0).cast("double")).otherwise(
        1.0 / F.col("_distance")
    )


def neighbor_means(
    df: DataFrame, key: str, columns: Sequence[str], k: int = 5, block_rows: int | None = None
) -> DataFrame:
    """One row per row with gaps: ``key`` and ``_v0, _v1, ...``, the weighted means of the
    k nearest donors for each missing column (null where nothing is missing or no donor exists)."""
    place = F.array(*[F.nanvl(col(c).cast("double"), F.lit(None)) for c in columns])
    rows = df.select(col(key).alias("_key"), place.alias("_place"))
    gaps = F.exists("_place", lambda v: v.isNull())
    queries = rows.filter(gaps).select(F.col("_key").alias("_q"), F.col("_place").alias("_x"))
    donors = rows.select(
        F.col("_key").alias("_d"), F.col("_place").alias("_y"), F.lit(None).cast("double").alias("_v")
    )
    found = nearest(queries, donors, len(columns), k, for_gaps=True, block_rows=block_rows)
    weighted = found.withColumn("_w", _weights())
    means = [
        (
            F.sum(F.when(F.col("_gap") == i, F.col("_w") * F.col("_v")))
            / F.sum(F.when(F.col("_gap") == i, F.col("_w")))
        ).alias(f"_v{i}")
        for i in range(len(columns))
    ]
    return weighted.groupBy(F.col("_q").alias(key)).agg(*means)


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    key: str,
    vector: str,
    label: str,
    width: int,
    k: int = 5,
    weights: str = "uniform",
    metric: str = "euclidean",
    block_rows: int | None = None,
) -> DataFrame:
    """``(key, prediction, score)``: vote of the k nearest training rows.

    ``vector`` is an array of numbers. Equal votes go to the smallest label; ``score`` is
    the winning share of the votes for label 1.
    """
    queries = test.select(col(key).alias("_q"), col(vector).cast("array<double>").alias("_x"))
    donors = train.select(
        col(key).alias("_d"), col(vector).cast("array<double>").alias("_y"), col(label).cast("double").alias("_v")
    )
    rows = nearest(queries, donors, width, k, metric, block_rows=block_rows)
    rows = rows.withColumn("_w", F.lit(1.0) if weights == "uniform" else _weights())
    votes = rows.groupBy("_q", "_v").agg(F.sum("_w").alias("_votes"))
    return (
        votes.groupBy(F.col("_q").alias(key))
        .agg(
            F.min(F.struct((-F.col("_votes")).alias("a"), F.col("_v").alias("v"))).alias("_best"),
            (F.sum(F.when(F.col("_v") == 1, F.col("_votes")).otherwise(0.0)) / F.sum("_votes")).alias("score"),
        )
        .select(key, F.col("_best.v").alias("prediction"), "score")
    )
