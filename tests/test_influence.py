"""Variance shares of parameters: against all cells of small boxes, and exact on toy logs."""

import itertools
import json

import numpy as np
import pytest

from wardtable.operators import search as S


def _random_boxes(rng, sizes):
    """Cuts the whole space at random into boxes with values."""
    todo, done = [([0] * len(sizes), list(sizes))], []
    while todo:
        lo, hi = todo.pop()
        wide = [j for j in range(len(sizes)) if hi[j] - lo[j] > 1]
        if not wide or rng.rand() < 0.2:
            done.append((lo, hi, rng.normal()))
            continue
        j = wide[rng.randint(len(wide))]
        cut = rng.randint(lo[j] + 1, hi[j])
        todo += [(lo, [*hi[:j], cut, *hi[j + 1 :]]), ([*lo[:j], cut, *lo[j + 1 :]], hi)]
    return tuple(np.array(v) for v in zip(*done))


@pytest.mark.parametrize("seed", range(5))
def test_variances_of_boxes_equal_those_of_all_cells(seed):
    rng = np.random.RandomState(seed)
    sizes = (4, 3, 5)
    low, high, said = _random_boxes(rng, sizes)
    weights = [w / w.sum() for w in (rng.rand(k) for k in sizes)]
    cells = np.zeros(sizes)
    for lo, hi, v in zip(low, high, said):
        cells[tuple(slice(a, b) for a, b in zip(lo, hi))] = v
    whole = np.einsum("i,j,k->ijk", *weights)
    mean = (whole * cells).sum()
    want = []
    for j in range(3):
        others = tuple(k for k in range(3) if k != j)
        along = (whole * cells).sum(axis=others) / weights[j]
        want.append((weights[j] * (along - mean) ** 2).sum())
    total, own = S.box_variances(low, high, said, weights)
    assert total == pytest.approx((whole * (cells - mean) ** 2).sum())
    assert own == pytest.approx(want)


def _log(spark, rows):
    return spark.createDataFrame([("COMPLETE", json.dumps(p), y) for p, y in rows], "state string, params string, f1 double")


def test_an_additive_log_is_taken_apart_exactly(spark):
    rows = [({"a": a, "b": b, "idle": c}, 3.0 * a + {"x": 0.0, "y": 1.0}[b]) for a, b, c in itertools.product(range(4), "xy", (0.1, 0.2))]
    found = {r["parameter"]: r for r in S.parameter_influence(_log(spark, rows), trees=1).collect()}
    of_a, of_b = 9 * np.var(range(4)), np.var([0, 1])
    assert found["a"]["share"] == pytest.approx(of_a / (of_a + of_b))
    assert found["b"]["influence"] == pytest.approx(of_b / (of_a + of_b))
    assert found["idle"]["share"] == pytest.approx(0.0, abs=1e-12)
    many = {r["parameter"]: r["share"] for r in S.parameter_influence(_log(spark, rows)).collect()}
    assert many["a"] > 0.9 > many["b"] > many["idle"]


def test_a_pure_combination_belongs_to_no_parameter(spark):
    values = {(0, 0): 1.0, (1, 1): 1.2, (0, 1): -1.1, (1, 0): -1.1}
    found = S.parameter_influence(_log(spark, [({"a": a, "b": b}, y) for (a, b), y in values.items()]), trees=1).collect()
    assert sum(r["share"] for r in found) < 0.01 and sum(r["influence"] for r in found) == pytest.approx(1.0)


def test_logs_without_variance_trials_or_some_values(spark):
    still = S.parameter_influence(_log(spark, [({"a": i}, 0.5) for i in range(4)])).collect()
    assert [(r["influence"], r["share"]) for r in still] == [(0.0, 0.0)]
    assert S.parameter_influence(_log(spark, [({"a": 1}, 0.5)]).filter("f1 > 1")).collect() == []
    some = S.parameter_influence(_log(spark, [({"a": 1, "k": "u"}, 0.1), ({"a": 2}, 0.9), ({"a": 3, "k": "v"}, 0.4)])).collect()
    assert {r["parameter"] for r in some} == {"a", "k"} and sum(r["influence"] for r in some) == pytest.approx(1.0)
