"""Moments of all column pairs in one scan: one mergeable state for each pair of column blocks.

Every task turns its Arrow batches into matrices and keeps, for each pair of blocks of columns, the
number of rows that have both values, both means, both sums of squares and the sum of products around these means.
States are merged by the parallel formulas for moments, so nothing cancels out when means are large,
and a column that is constant over a pair's rows has a sum of squares of exactly 0. A row makes no
further rows: what is shuffled is one state per task and pair of blocks, merged in two rounds, each in
the memory of two states. A task holds six numbers for each pair of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.functions.expressions import known

#: Columns of one block.
BLOCK = 64
#: States that one group of the first round merges.
FIRST_ROUND = 128
#: Rows of a batch that give its provisional centre.
CENTRE_ROWS = 512

_STATE = "i int, j int, task int, state array<double>"
_PARTS = 6  # n, mean_i, mean_j, squares_i, squares_j, products


def _centre(x: np.ndarray) -> np.ndarray:
    """A value of each column near its middle, taken from some rows; 0 without one. It only keeps sums small."""
    some = np.sort(x[:: max(1, len(x) // CENTRE_ROWS)], axis=0)  # missing values come last
    filled = (~np.isnan(some)).sum(axis=0)
    middle = some[filled // 2 - (filled > 0) * (filled % 2 == 0), np.arange(x.shape[1])]
    return np.where(np.isnan(middle), 0.0, middle)


def batch_state(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """State of the columns of ``x`` against those of ``y``, of shape (6, columns of x, columns of y); NaN is missing."""
    a, b = _centre(x), _centre(y)
    has_x, has_y = ~np.isnan(x), ~np.isnan(y)
    p, q = np.where(has_x, x - a, 0.0), np.where(has_y, y - b, 0.0)
    has_x, has_y = has_x.astype("f8"), has_y.astype("f8")
    n = has_x.T @ has_y
    rows = np.maximum(n, 1.0)
    mean_x, mean_y = p.T @ has_y / rows, has_x.T @ q / rows
    squares_x = np.maximum((p * p).T @ has_y - rows * mean_x**2, 0.0)
    squares_y = np.maximum(has_x.T @ (q * q) - rows * mean_y**2, 0.0)
    products = p.T @ q - rows * mean_x * mean_y
    none = n == 0
    out = np.stack([n, mean_x + a[:, None], mean_y + b[None, :], squares_x, squares_y, products])
    out[1:, none] = 0.0
    return out


def merge_states(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The state of all rows behind ``s`` and ``t``."""
    n = s[0] + t[0]
    rows = np.maximum(n, 1.0)
    both = s[0] * t[0] / rows
    one = both > 0
    dx, dy = np.where(one, t[1] - s[1], 0.0), np.where(one, t[2] - s[2], 0.0)
    only_t = (s[0] == 0) & (t[0] > 0)
    mean_x = np.where(only_t, t[1], s[1] + dx * t[0] / rows)
    mean_y = np.where(only_t, t[2], s[2] + dy * t[0] / rows)
    return np.stack([n, mean_x, mean_y, s[3] + t[3] + both * dx * dx, s[4] + t[4] + both * dy * dy, s[5] + t[5] + both * dx * dy])


def _states(df: DataFrame, width: int) -> DataFrame:
    starts = range(0, width, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for i in starts:
                for j in starts:
                    if j >= i:
                        state = batch_state(x[:, i : i + BLOCK], x[:, j : j + BLOCK])
                        held[i, j] = merge_states(held[i, j], state) if (i, j) in held else state
        task = TaskContext.get().partitionId()
        for (i, j), state in held.items():
            yield _row(i, j, task, state)

    return df.mapInArrow(run, _STATE)


def _row(i: int, j: int, task: int, state: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([v], pa.int32()) for v in (i, j, task)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([state.ravel()], pa.list_(pa.float64()))], ["i", "j", "task", "state"])


def _merged(states: DataFrame, width: int, keys: list[str], schema: str, finish: Callable[..., pa.RecordBatch]) -> DataFrame:
    """States of equal ``keys`` merged while they stream by in order; ``finish(i, j, task, state)`` makes the rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, held = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, task = (batch.column(c)[k].as_py() for c in range(3))
                shape = (_PARTS, min(BLOCK, width - i), min(BLOCK, width - j))
                state = batch.column(3)[k].values.to_numpy().reshape(shape)
                own = (i, j, task)[: len(keys)]
                if own == mine:
                    held = merge_states(held, state)
                    continue
                if mine is not None:
                    yield finish(*mine[:2], mine[-1], held)
                mine, held = own, state
        if mine is not None:
            yield finish(*mine[:2], mine[-1], held)

    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


_MOMENTS = ["n", "mean_i", "mean_j", "squares_i", "squares_j", "products"]


def _pairs(i: int, j: int, _: int, state: np.ndarray) -> pa.RecordBatch:
    """Rows of the pairs above the diagonal."""
    a, b = (x.ravel() for x in np.meshgrid(np.arange(i, i + state.shape[1]), np.arange(j, j + state.shape[2]), indexing="ij"))
    ok = a < b
    columns = [pa.array(x[ok].astype("i4")) for x in (a, b)] + [pa.array(state[0].ravel()[ok].astype("i8"))]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(s.ravel()[ok]) for s in state[1:]]], ["i", "j", *_MOMENTS])


def pair_moments(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """``i, j, n, mean_i, mean_j, squares_i, squares_j, products`` for every pair i < j of ``values``, over rows that have both.

    Null and NaN are missing. Pairs without a row have n = 0; a table without a row may give no pairs.
    """
    width = len(values)
    numbers = df.select(*[known(v.cast("double")).alias(f"v{k}") for k, v in enumerate(values)])
    first = _states(numbers, width).withColumn("task", F.expr(f"task div {FIRST_ROUND}").cast("int"))
    states = _merged(first, width, ["i", "j", "task"], _STATE, _row)
    schema = "i int, j int, n bigint, " + ", ".join(f"{c} double" for c in _MOMENTS[1:])
    return _merged(states, width, ["i", "j"], schema, _pairs)
