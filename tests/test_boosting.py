"""Boosted trees against a plain version, and on both ways to split a node."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wardtable.operators import boosting as B
from wardtable.operators import models as M


def plain_margins(rows, labels, s):
    """Greedy trees over all thresholds, row by row, without bins, sampling or rounding."""
    margins = [0.0] * len(rows)

    def score(g, h):
        t = math.copysign(max(abs(g) - s.reg_alpha, 0.0), g)
        return t * t / (h + s.reg_lambda)

    for _ in range(s.n_estimators):
        gh = []
        for y, m in zip(labels, margins):
            p, w = 1 / (1 + math.exp(-m)), s.scale_pos_weight if y else 1.0
            gh.append((w * (p - y), w * p * (1 - p)))

        def split(members, depth):
            g, h = (sum(gh[i][k] for i in members) for k in (0, 1))
            best = None
            for f in range(len(rows[0])) if depth < s.max_depth else ():
                for cut in sorted({rows[i][f] for i in members})[:-1]:
                    left = [i for i in members if rows[i][f] <= cut]
                    gl, hl = (sum(gh[i][k] for i in left) for k in (0, 1))
                    if hl < s.min_child_weight or h - hl < s.min_child_weight:
                        continue
                    gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
                    if gain >= max(s.gamma, 1e-6) and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut)
            if best is None:
                t = math.copysign(max(abs(g) - s.reg_alpha, 0.0), g)
                for i in members:
                    margins[i] -= s.learning_rate * t / (h + s.reg_lambda)
                return
            for side in (True, False):
                split([i for i in members if (rows[i][best[1]] <= best[2]) == side], depth + 1)

        split(list(range(len(rows))), 0)
    return margins


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [[float(rng.randrange(30)), rng.random(), float(rng.randrange(3))] for _ in range(160)]
    labels = [int(a / 30 + b + 0.3 * c + rng.random() * 0.5 > 1.2) for a, b, c in rows]
    made = spark.createDataFrame([(str(i), r, float(y)) for i, (r, y) in enumerate(zip(rows, labels))], "k string, x array<double>, y double")
    return made.select("k", array_to_vector("x").alias("features"), "y").persist(), rows, labels


@pytest.mark.parametrize(
    "given",
    [
        {"reg_lambda": 0.1, "reg_alpha": 0.3, "gamma": 0.05, "min_child_weight": 2.0, "scale_pos_weight": 2.0, "max_depth": 5},
        {"reg_lambda": 1.0, "max_depth": 2},
        {"reg_lambda": 0.5, "max_depth": 3, "min_child_weight": 0.0, "gamma": 0.5},
    ],
)
def test_equals_a_plain_version(table, given):
    df, rows, labels = table
    s = B.Settings(n_estimators=5, learning_rate=0.3, **given)
    model = B.fit_trees(df, "features", "y", "k", s)
    got = {int(r["k"]): r["p"] for r in model.transform(df).select("k", F.col("probability")[1].alias("p")).collect()}
    for i, m in enumerate(plain_margins(rows, labels, s)):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-5)


def test_large_and_small_nodes_give_the_same_trees(table, monkeypatch):
    df = table[0]
    monkeypatch.setattr(B, "REFRESH", 2)
    s = B.Settings(n_estimators=5, max_depth=4, subsample=0.8, colsample_bytree=0.7, reg_alpha=0.1, scale_pos_weight=3.0)
    whole = B.fit_trees(df, "features", "y", "k", s)
    mixed = B.fit_trees(df.repartition(7), "features", "y", "k", s, in_task=40)
    monkeypatch.setattr(B, "CELLS", 1)
    levels = B.fit_trees(df.repartition(3), "features", "y", "k", s, in_task=0)
    trees = [json.loads(m.getOrDefault("trees")) for m in (whole, mixed, levels)]
    assert trees[0] == trees[1] == trees[2]
    assert any(t["splits"] for t in trees[0])


def test_edges(spark, table):
    df = table[0]
    empty = B.fit_trees(df.limit(0), "features", "y", "k", B.Settings(n_estimators=2))
    assert {tuple(r[0]) for r in empty.transform(df).select("probability").collect()} == {(0.5, 0.5)}
    one = B.fit_trees(df.filter("y = 1"), "features", "y", None, B.Settings(n_estimators=2))
    assert one.transform(df).agg(F.min(F.col("probability")[1])).first()[0] > 0.5
    with pytest.raises(ValueError):
        B.Settings(subsample=0)


def test_saved_model_scores_alike(table, tmp_path):
    df = table[0]
    model = M.fit(df, "gradient_boosting", {"n_estimators": 3, "max_depth": 3, "reg_alpha": 0.2, "nthread": 4}, "y", "k")
    assert model.ignored == ["nthread"]
    assert sum(M.importances(model)) == pytest.approx(1.0)
    model.save(str(tmp_path / "m"))
    again = M.load(str(tmp_path / "m"), "gradient_boosting")
    take = lambda m: sorted(tuple(r) for r in M.score_rows(m, df, "y", ["k"]).collect())
    assert take(model) == take(again)


def test_without_prior(spark):
    """Scores of both classes' smoothed likelihoods alone, counted by hand."""
    rows = [(1, 1.0)] * 6 + [(0, 1.0)] * 2 + [(1, 0.0)] * 1 + [(0, 0.0)] * 3
    df = spark.createDataFrame([([float(x)], y) for x, y in rows], "x array<double>, y double").select(array_to_vector("x").alias("features"), "y")
    model = M.fit(df, "bernoulli_bayes", {"fit_prior": False, "alpha": 1.0, "binarize": 0.5}, "y")
    got = {r["x"][0]: r["p"][1] for r in model.transform(df).select(F.col("features").alias("x"), F.col("probability").alias("p")).collect()}
    high, low = 7 / 10, 2 / 6  # share of ones by class: (6 + 1) / (8 + 2), (1 + 1) / (4 + 2)
    assert got[1.0] == pytest.approx(high / (high + low)) and got[0.0] == pytest.approx((1 - high) / ((1 - high) + (1 - low)))


def test_a_table_in_one_partition_is_dealt_out_and_a_level_takes_one_shuffle(spark, table, monkeypatch):
    df, _, _ = table
    settings = B.Settings(n_estimators=3, max_depth=5, learning_rate=0.3, subsample=0.7)
    want = B.fit_trees(df, "features", "y", "k", settings).getOrDefault("trees")
    seen, plans, write, splits = [], [], B._one_tree, B.node_splits
    monkeypatch.setattr(B, "TASK_ROWS", 20)
    monkeypatch.setattr(B, "_one_tree", lambda state, *a: (seen.append(state.rdd.getNumPartitions()), write(state, *a))[1])

    def planned(sums, s):
        out = splits(sums, s)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(B, "node_splits", planned)
    assert B.fit_trees(df.coalesce(1), "features", "y", "k", settings, in_task=10).getOrDefault("trees") == want
    assert min(seen) > 1 and plans and all(p.count("Exchange") == 1 for p in plans)


def test_a_small_table_is_learnt_in_one_task(spark, monkeypatch):
    """All trees of it come from one job, and are those of one job a level."""
    rng = np.random.RandomState(8)
    x = rng.normal(size=(300, 3))
    rows = [(i, [float(v) for v in r], float(r.sum() > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, x array<double>, y double").select("k", "y", array_to_vector("x").alias("features"))
    s = B.Settings(n_estimators=4, max_depth=4, subsample=0.7, colsample_bytree=0.7)
    monkeypatch.setattr(B, "REFRESH_ROWS", 700)  # margins are written every second tree
    levels = B.fit_trees(df, "features", "y", "k", s, in_task=0)
    monkeypatch.setattr(B, "_one_tree", None)
    whole = B.fit_trees(df, "features", "y", "k", s)
    assert whole.getOrDefault("trees") == levels.getOrDefault("trees")
