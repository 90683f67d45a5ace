"""Gradient boosting with first and second derivatives of the logistic loss.

Rows are kept as one byte per feature (the bin of its value) and the margin of the trees so far. A node with more than
``IN_TASK`` rows is split by a grouped sum of both derivatives per (node, feature, bin); running sums over the at most 256
bins and the best split are made per (node, feature) after one shuffle, and the driver receives one row for each. A node
with at most ``IN_TASK`` rows goes to one task, which grows the rest of its branch. Both ways take the same sums and the
same order among equal gains, so that the trees do not depend on which one a node took, nor on partitions: derivatives
are rounded to whole multiples of 2^-24 of the largest one, and sums of whole numbers are exact.

A table with at most ``IN_TASK`` rows is one such node for every tree, so that one task grows all trees without a job for each.

Every ``REFRESH`` trees, large tables more often, the margins are written to the folder that ``spark.checkpoint.dir`` names, which
cuts the lineage and spares each pass the trees before it.

Gain of a split: score(left) + score(right) - score(node), with score = t(G)^2 / (H + lambda), where t draws the sum
of first derivatives G towards 0 by alpha. A split needs a gain above ``gamma`` and both sides ``min_child_weight``
of second derivatives. A leaf adds -learning_rate * t(G) / (H + lambda).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import col
from wardtable.session import delete_folder, new_folder

#: A node with at most so many rows is grown in one task.
IN_TASK = 50_000
#: Cells (node, feature, bin) that a task sums up in one pass over its rows.
CELLS = 1 << 22
#: Rows that a task works through in a pass; a table that is kept on fewer tasks than it is worth is dealt out to all cores.
TASK_ROWS = 5_000
#: Trees between two writes of the margins, at most, and trees times rows: each pass adds up the trees since the last write.
REFRESH, REFRESH_ROWS = 16, 800_000
#: Derivatives are whole multiples of this part of the largest one.
_UNIT = float(1 << 24)
_SPLIT = pa.schema([
    ("node", pa.int64()), ("feature", pa.int32()), ("n", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("gain", pa.float64()),
    ("bin", pa.int32()), ("n_left", pa.int64()),
])
#: Splits that gain less are noise of the rounding.
LEAST_GAIN = 1e-6


@dataclass
class Settings:
    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    scale_pos_weight: float = 1.0
    max_bins: int = 256
    seed: int = 99

    def __post_init__(self):
        if not 2 <= self.max_bins <= 256:
            raise ValueError("max_bins lies between 2 and 256")
        if not (0 < self.subsample <= 1 and 0 < self.colsample_bytree <= 1):
            raise ValueError("subsample and colsample_bytree lie above 0 and up to 1")
        if min(self.gamma, self.min_child_weight, self.reg_alpha, self.reg_lambda) < 0 or self.scale_pos_weight <= 0:
            raise ValueError("penalties and weights are not negative")

    @property
    def unit(self) -> float:
        return _UNIT / max(1.0, self.scale_pos_weight)

    def drawn(self, g):
        """First derivatives drawn towards 0 by alpha."""
        return np.sign(g) * np.maximum(np.abs(g) - self.reg_alpha, 0.0)

    def score(self, g, h):
        d = self.drawn(g)
        return np.divide(d * d, h + self.reg_lambda, out=np.zeros_like(d), where=h + self.reg_lambda > 0)

    def leaf(self, g: float, h: float) -> float:
        return float(-self.learning_rate * self.drawn(g) / (h + self.reg_lambda)) if h + self.reg_lambda > 0 else 0.0


@dataclass
class Tree:
    """Nodes by number: 1 is the root, 2n and 2n + 1 are the sides of n. A split is (feature, bin, gain), a leaf a value."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)
    _known: tuple | None = field(default=None, init=False, repr=False, compare=False)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Numbers of the known nodes in order; of each whether it is split, feature, cut, place of its left side, and leaf value.

        They are made again only when the tree has grown, and go to the tasks with it. The sides of a node lie next to each other.
        """
        size = (len(self.splits), len(self.leaves))
        if self._known is None or self._known[0] != size:
            nodes = np.array(sorted({1, *self.leaves, *self.splits, *(2 * n + k for n in self.splits for k in (0, 1))}), dtype="i8")
            inner = np.array([n in self.splits for n in nodes.tolist()])
            found = [self.splits.get(n, (0, 0, 0.0)) for n in nodes.tolist()]
            feature, cut = (np.array([f[k] for f in found], dtype="i8") for k in (0, 1))
            left = np.searchsorted(nodes, 2 * nodes)
            value = np.array([self.leaves.get(n, 0.0) for n in nodes.tolist()])
            self._known = (size, (nodes, inner, feature, cut, left, value))
        return self._known[1]

    def _place(self, bins: np.ndarray) -> np.ndarray:
        """Place of the deepest known node of every row."""
        _, inner, feature, cut, left, _ = self.arrays()
        at = np.zeros(len(bins), dtype="i8")
        moving = np.arange(len(bins) if inner[0] else 0)
        while len(moving):
            here = at[moving]
            here = left[here] + (bins[moving, feature[here]] > cut[here])
            at[moving] = here
            moving = moving[inner[here]]
        return at

    def reach(self, bins: np.ndarray) -> np.ndarray:
        """The deepest known node of every row."""
        return self.arrays()[0][self._place(bins)]

    def add(self, bins: np.ndarray) -> np.ndarray:
        """What the tree adds to the margin of every row."""
        return self.arrays()[5][self._place(bins)]


# --- one branch in one task ---------------------------------------------------


def _gains(nl: np.ndarray, gl: np.ndarray, hl: np.ndarray, n, g, h, s: Settings) -> np.ndarray:
    """Gain of each split from the rows and derivatives on its left and in the node; -1 where a side is too small."""
    u = s.unit
    gain = s.score(gl / u, hl / u) + s.score((g - gl) / u, (h - hl) / u) - s.score(np.array([g / u]), np.array([h / u]))
    enough = (hl / u >= s.min_child_weight) & ((h - hl) / u >= s.min_child_weight) & (nl > 0) & (nl < n)
    return np.where(enough, gain, -1.0)


def best_split(
    bins: np.ndarray, g: np.ndarray, h: np.ndarray, s: Settings, features: Sequence[int]
) -> tuple[int, int, float] | None:
    """(feature, bin, gain) of the best split of these rows; the smallest feature and bin among equals."""
    width = s.max_bins
    cells = (bins[:, features].astype("i8") + np.arange(len(features)) * width).ravel()
    shape = (len(features), width)

    def upto(v: np.ndarray) -> np.ndarray:
        return np.bincount(cells, np.repeat(v, len(features)), shape[0] * width).reshape(shape).cumsum(axis=1)

    n = np.bincount(cells, minlength=shape[0] * width).reshape(shape).cumsum(axis=1)
    gl, hl = upto(g), upto(h)
    whole_g, whole_h = g.sum(), h.sum()
    gain = _gains(n, gl, hl, len(g), whole_g, whole_h, s)
    at = int(gain.argmax())
    top = float(gain.flat[at])
    return (int(features[at // width]), at % width, top) if top > LEAST_GAIN and top >= s.gamma else None


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, s: Settings, features: Sequence[int], root: int = 1) -> Tree:
    """The branch below ``root`` from all its rows."""
    tree, open_ = Tree(), [(root, np.arange(len(g)))]
    while open_:
        node, rows = open_.pop()
        deep = node.bit_length() - 1
        found = best_split(bins[rows], g[rows], h[rows], s, features) if deep < s.max_depth and len(rows) > 1 else None
        if found is None:
            tree.leaves[node] = s.leaf(g[rows].sum() / s.unit, h[rows].sum() / s.unit)
            continue
        tree.splits[node] = found
        right = bins[rows, found[0]] > found[1]
        open_ += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
    return tree


# --- rows of a task -----------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of 64 bits."""
    x = x.astype("u8")
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(ids: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Rows that a tree learns from, by a hash of row, tree and seed."""
    if s.subsample >= 1:
        return np.ones(len(ids), dtype=bool)
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([tree + 1], dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s.seed))
        return (_mixed(ids.astype("u8") + salt) >> np.uint64(11)) < np.uint64(int(s.subsample * (1 << 53)))


def tree_features(width: int, tree: int, s: Settings) -> list[int]:
    count = max(1, int(s.colsample_bytree * width))
    if count >= width:
        return list(range(width))
    return sorted(np.random.RandomState([s.seed, tree]).permutation(width)[:count].tolist())


def derivatives(y: np.ndarray, margin: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted loss, in units."""
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, s.scale_pos_weight, 1.0)
    return np.rint(w * (p - y) * s.unit), np.rint(w * np.maximum(p * (1 - p), 1e-16) * s.unit)


def _bytes_of(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values one after the other, where they lie in the batch."""
    ends = np.frombuffer(column.buffers()[1], dtype="i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype="u1")[ends[0] : ends[-1]]


def _columns(batch: pa.RecordBatch, width: int, later: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row hash, label, margin with the trees since the last write, and bins."""
    named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    bins = _bytes_of(named["_bins"]).reshape(-1, width)
    margin = named["_m"].to_numpy(zero_copy_only=False).copy()
    for tree in later:
        margin += tree.add(bins)
    return named["_id"].to_numpy(zero_copy_only=False), named["_y"].to_numpy(zero_copy_only=False), margin, bins


def _learning(batches: Iterator[pa.RecordBatch], width: int, later: list[Tree], tree: Tree, number: int, s: Settings):
    """Node, bins and both derivatives of the rows that a tree learns from."""
    for batch in batches:
        if batch.num_rows:
            ids, y, margin, bins = _columns(batch, width, later)
            here = sampled(ids, number, s)
            g, h = derivatives(y[here], margin[here], s)
            yield tree.reach(bins[here]), bins[here], g, h


# --- levels of large nodes ----------------------------------------------------


def _sums(state: DataFrame, width: int, later, tree, number, s: Settings, nodes: list[int], features) -> DataFrame:
    """Rows, first and second derivatives per (node, feature, bin) of the given nodes; one partial row per task."""
    cells = len(nodes) * len(features) * s.max_bins
    wanted = np.array(sorted(nodes), dtype="i8")

    def run(batches):
        held = np.zeros((3, cells), dtype="i8")
        for node, bins, g, h in _learning(batches, width, later, tree, number, s):
            place = np.minimum(np.searchsorted(wanted, node), len(wanted) - 1)
            here = wanted[place] == node
            base = place[here] * len(features)
            for k, f in enumerate(features):
                cell = (base + k) * s.max_bins + bins[here, f]
                held[0] += np.bincount(cell, minlength=cells)
                held[1] += np.bincount(cell, g[here], cells).astype("i8")
                held[2] += np.bincount(cell, h[here], cells).astype("i8")
        some = np.flatnonzero(held[0])
        for start in range(0, len(some), 50_000):
            part = some[start : start + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(wanted[part // (len(features) * s.max_bins)]),
                    pa.array(np.array(features, dtype="i4")[part // s.max_bins % len(features)]),
                    pa.array((part % s.max_bins).astype("i4")),
                    *[pa.array(v) for v in held[:, part]],
                ],
                names=["node", "feature", "bin", "n", "g", "h"],
            )

    return state.mapInArrow(run, "node bigint, feature int, bin int, n bigint, g bigint, h bigint")


def node_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """For each node and feature the node's rows and derivatives, and the best split (null without one) with the rows on the left.

    One shuffle: the sums of a feature, at most ``max_bins`` from each task, meet in one group.
    """

    def best(table: pa.Table) -> pa.Table:
        bins = table["bin"].to_numpy()
        n, g, h = (np.bincount(bins, table[c].to_numpy(), s.max_bins) for c in "ngh")  # whole numbers, exact
        nl, gl, hl = (v.cumsum() for v in (n, g, h))
        gain = _gains(nl, gl, hl, nl[-1], gl[-1], hl[-1], s)
        at = int(gain.argmax())
        top = float(gain[at])
        found = (top, at, int(nl[at])) if top > LEAST_GAIN and top >= s.gamma else (None, None, None)
        row = [table["node"][0].as_py(), table["feature"][0].as_py(), int(nl[-1]), int(gl[-1]), int(hl[-1]), *found]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(_SPLIT, row)})

    return sums.groupBy("node", "feature").applyInArrow(best, "node bigint, feature int, n bigint, g bigint, h bigint, gain double, bin int, n_left bigint")


def _best_rows(rows: list) -> dict:
    """Of the rows of each node that of the best split; the smallest feature among equals."""
    out = {}
    for r in sorted(rows, key=lambda r: (-(r["gain"] or 0.0), r["feature"])):
        out.setdefault(r["node"], r)
    return out


def _branches(state: DataFrame, width: int, later, tree: Tree, number: int, s: Settings, nodes: list[int], features) -> Tree:
    """Branches of nodes that are small enough for one task each."""
    wanted = np.array(sorted(nodes), dtype="i8")

    def rows(batches):
        for node, bins, g, h in _learning(batches, width, later, tree, number, s):
            here = np.isin(node, wanted)
            flat = np.ascontiguousarray(bins[here]).tobytes()
            cut = [flat[i : i + width] for i in range(0, len(flat), width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[here]), pa.array(cut, pa.binary()), pa.array(g[here]), pa.array(h[here])], names=["node", "_bins", "g", "h"]
            )

    def branch(table: pa.Table) -> pa.Table:
        bins = np.frombuffer(b"".join(table["_bins"].to_pylist()), dtype="u1").reshape(-1, width)
        got = grow(bins, table["g"].to_numpy(), table["h"].to_numpy(), s, features, table["node"][0].as_py())
        nodes = [*got.splits, *got.leaves]
        split = [got.splits.get(n, (None, None, None)) for n in nodes]
        return pa.table({
            "node": pa.array(nodes, pa.int64()), "feature": pa.array([f for f, _, _ in split], pa.int32()),
            "bin": pa.array([b for _, b, _ in split], pa.int32()), "gain": pa.array([v for _, _, v in split], pa.float64()),
            "leaf": pa.array([got.leaves.get(n) for n in nodes], pa.float64()),
        })

    learning = state.mapInArrow(rows, "node bigint, _bins binary, g double, h double")
    out = Tree()
    found = learning.groupBy("node").applyInArrow(branch, "node bigint, feature int, bin int, gain double, leaf double")
    for r in found.collect():  # nodes of one tree
        if r["feature"] is None:
            out.leaves[r["node"]] = r["leaf"]
        else:
            out.splits[r["node"]] = (r["feature"], r["bin"], r["gain"])
    for node in wanted.tolist():
        if node not in out.leaves and node not in out.splits:
            out.leaves[node] = 0.0  # no row was sampled
    return out


def _one_tree(state: DataFrame, rows: int, width: int, later: list[Tree], number: int, s: Settings, in_task: int) -> Tree:
    features = tree_features(width, number, s)
    tree, large, small = Tree(), [], []
    (large if rows > in_task else small).append(1)
    at_once = max(1, CELLS // (len(features) * s.max_bins))
    while large:
        level, large = large, []
        for start in range(0, len(level), at_once):
            sums = _sums(state, width, later, tree, number, s, level[start : start + at_once], features)
            found = _best_rows(node_splits(sums, s).collect())  # one row per node and feature
            for node in level[start : start + at_once]:
                r = found.get(node)
                if r is None or r["gain"] is None or node.bit_length() > s.max_depth:
                    tree.leaves[node] = s.leaf(r["g"] / s.unit, r["h"] / s.unit) if r else 0.0
                    continue
                tree.splits[node] = (r["feature"], r["bin"], r["gain"])
                for side, count in ((2 * node, r["n_left"]), (2 * node + 1, r["n"] - r["n_left"])):
                    (large if count > in_task else small).append(side)
    if small:
        rest = _branches(state, width, later, tree, number, s, small, features)
        tree.splits |= rest.splits
        tree.leaves |= rest.leaves
    return tree


def _in_one_task(state: DataFrame, width: int, s: Settings) -> list[Tree]:
    """All trees of a table that is small enough for one task."""

    def run(batches):
        parts = [_columns(b, width, []) for b in batches if b.num_rows]
        if not parts:
            return
        ids, y, margin, bins = (np.concatenate(c) for c in zip(*parts))
        for number in range(s.n_estimators):
            here = sampled(ids, number, s)
            g, h = derivatives(y[here], margin[here], s)
            tree = grow(bins[here], g, h, s, tree_features(width, number, s)) if here.any() else Tree(leaves={1: 0.0})
            margin += tree.add(bins)
            nodes = [*tree.splits, *tree.leaves]
            split = [tree.splits.get(n, (None, None, None)) for n in nodes]
            columns = [[number] * len(nodes), nodes, *map(list, zip(*split)), [tree.leaves.get(n) for n in nodes]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "node", "feature", "bin", "gain", "leaf"])

    trees = [Tree() for _ in range(s.n_estimators)]
    found = state.coalesce(1).mapInArrow(run, "tree int, node bigint, feature int, bin int, gain double, leaf double")
    for r in found.toLocalIterator():  # nodes of the trees
        if r["feature"] is None:
            trees[r["tree"]].leaves[r["node"]] = r["leaf"]
        else:
            trees[r["tree"]].splits[r["node"]] = (r["feature"], r["bin"], r["gain"])
    return trees


# --- fit and score ------------------------------------------------------------


def bin_cuts(df: DataFrame, features: str, width: int, max_bins: int) -> list[list[float]]:
    """At most ``max_bins`` - 1 increasing cuts for each feature, values of its own below the largest one."""
    shares = [i / max_bins for i in range(1, max_bins)]
    x = vector_to_array(col(features))
    cuts = df.select(x.alias("x")).agg(*[
        F.struct(F.percentile_approx(F.col("x")[i], shares, 100 * max_bins).alias("q"), F.max(F.col("x")[i]).alias("top")).alias(f"f{i}")
        for i in range(width)
    ]).first()
    return [sorted({float(v) for v in (c["q"] or []) if v < c["top"]}) for c in cuts]


def fit_trees(df: DataFrame, features: str, label: str, key: str | None, s: Settings, in_task: int = IN_TASK) -> BoostedTrees:
    """Trees for a 0/1 label. ``key`` tells rows apart for the sampling; without one, equal rows are sampled together.

    An empty table gives no trees and scores of 0.5.
    """
    spark = df.sparkSession
    first = df.select(F.size(vector_to_array(col(features)))).first()
    if first is None:
        return BoostedTrees(trees="[]", featuresCol=features)
    width, rows = first[0], df.count()
    cuts = bin_cuts(df, features, width, s.max_bins)

    @F.pandas_udf("binary")
    def binned(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="object")
        m = np.array([np.asarray(v, dtype="f8") for v in x]).reshape(len(x), width)
        bins = np.stack([np.searchsorted(np.array(cuts[i]), m[:, i]) for i in range(width)], axis=1).astype("u1")
        return pd.Series([r.tobytes() for r in bins])

    x = vector_to_array(col(features))
    row = F.xxhash64(col(key).cast("string")) if key else F.xxhash64(x, col(label).cast("double"))
    folder = new_folder(spark, "boosting")
    start = df.select(row.alias("_id"), col(label).cast("double").alias("_y"), binned(x).alias("_bins"), F.lit(0.0).alias("_m"))
    wanted = min(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    dealt = start.repartition(wanted) if start.rdd.getNumPartitions() < wanted else start
    dealt.write.parquet(folder)
    state = spark.read.parquet(folder)
    whole = rows <= in_task
    trees = _in_one_task(state, width, s) if whole else []
    later: list[Tree] = []
    refresh = min(REFRESH, max(1, REFRESH_ROWS // rows))
    for number in range(0 if whole else s.n_estimators):
        tree = _one_tree(state, rows, width, later, number, s, in_task)
        tree.arrays()
        trees.append(tree)
        later = [*later, tree]
        if len(later) == refresh and number + 1 < s.n_estimators:
            state, folder = _written(state, folder, width, later)
            later = []
    delete_folder(spark, folder)
    shown = [_shown(t, cuts) for t in trees]
    return BoostedTrees(trees=json.dumps(shown), featuresCol=features, width=width)


def _written(state: DataFrame, folder: str, width: int, later: list[Tree]) -> tuple[DataFrame, str]:
    """The rows with new margins, written; the rows before them are deleted."""

    def run(batches):
        for batch in batches:
            _, _, margin, _ = _columns(batch, width, later) if batch.num_rows else (None, None, np.array([]), None)
            yield batch.set_column(batch.schema.get_field_index("_m"), "_m", pa.array(margin, pa.float64()))

    spark = state.sparkSession
    after = new_folder(spark, "boosting")
    state.mapInArrow(run, state.schema).write.parquet(after)
    delete_folder(spark, folder)
    return spark.read.parquet(after), after


def _shown(tree: Tree, cuts: list[list[float]]) -> dict:
    return {
        "splits": [[n, f, cuts[f][b], gain] for n, (f, b, gain) in sorted(tree.splits.items())],
        "leaves": [[n, v] for n, v in sorted(tree.leaves.items())],
    }


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (both classes) and ``prediction`` to rows with a feature vector."""

    trees = Param(Params._dummy(), "trees", "splits and leaves of each tree as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, trees="[]", featuresCol="features", width=0):
        super().__init__()
        self._setDefault(trees="[]", featuresCol="features", width=0)
        self._set(**self._input_kwargs)

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of the splits on each feature, as shares."""
        total, count = np.zeros(self.getOrDefault("width")), np.zeros(self.getOrDefault("width"))
        for tree in json.loads(self.getOrDefault("trees")):
            for _, f, _, gain in tree["splits"]:
                total[f] += gain
                count[f] += 1
        mean = total / np.maximum(count, 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shown = json.loads(self.getOrDefault("trees"))
        thresholds = [sorted({v for t in shown for _, f, v, _ in t["splits"] if f == i}) for i in range(self.getOrDefault("width"))]
        place = [{v: k for k, v in enumerate(found)} for found in thresholds]
        trees = [
            Tree({n: (f, place[f][v], gain) for n, f, v, gain in t["splits"]}, {n: v for n, v in t["leaves"]}) for t in shown
        ]

        @F.pandas_udf("array<double>")
        def both(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="object")
            m = np.array([np.asarray(v, dtype="f8") for v in x])
            ranks = [np.searchsorted(np.array(found), m[:, i]) for i, found in enumerate(thresholds)]
            bins = np.stack(ranks, axis=1) if ranks else np.zeros((len(x), 0), dtype="i8")
            margin = np.zeros(len(x))
            for tree in trees:
                margin += tree.add(bins)
            p = 1.0 / (1.0 + np.exp(-margin))
            return pd.Series(list(np.stack([1 - p, p], axis=1)))

        out = dataset.withColumn("probability", both(vector_to_array(col(self.getOrDefault("featuresCol")))))
        return out.withColumn("prediction", (F.col("probability")[1] > 0.5).cast("double"))
