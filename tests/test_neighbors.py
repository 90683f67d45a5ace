"""Nearest neighbours against brute force, with blocks and cells made tiny."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardtable.operators import impute as I
from wardtable.operators import neighbors as N


def nan_distance(a, b):
    ok = ~(np.isnan(a) | np.isnan(b))
    return np.sqrt(((a[ok] - b[ok]) ** 2).sum() * len(a) / ok.sum()) if ok.any() else np.nan


def brute_impute(x, k):
    out = x.copy()
    means = np.nanmean(x, axis=0)
    for i in range(len(x)):
        for j in np.flatnonzero(np.isnan(x[i])):
            near = [(nan_distance(x[i], x[d]), d) for d in range(len(x)) if not np.isnan(x[d, j])]
            near = sorted(n for n in near if not np.isnan(n[0]))[:k]
            if not near:
                out[i, j] = means[j]
                continue
            dist, v = np.array([d for d, _ in near]), np.array([x[r, j] for _, r in near])
            w = (dist == 0).astype(float) if (dist == 0).any() else 1 / dist
            out[i, j] = (w * v).sum() / w.sum()
    return out


def frame(spark, x):
    return spark.createDataFrame(
        [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
        "id bigint, " + ", ".join(f"c{j} double" for j in range(x.shape[1])),
    )


@pytest.mark.parametrize("shape", ["spread", "hot point", "many gaps"])
def test_impute_matches_brute_force(spark, shape):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(300, 3)) * [1, 20, 300]
    if shape == "hot point":
        x[:120] = [1.0, 2.0, 3.0]  # more than a third of the rows share one place
    x[rng.uniform(size=x.shape) < (0.45 if shape == "many gaps" else 0.1)] = np.nan
    means = N.neighbor_means(frame(spark, x), "id", ["c0", "c1", "c2"], 5, block_rows=64)
    got = x.copy()
    for r in means.collect():
        for j in range(3):
            if r[f"_v{j}"] is not None and np.isnan(got[r["id"], j]):
                got[r["id"], j] = r[f"_v{j}"]
    column = np.nanmean(x, axis=0)
    got = np.where(np.isnan(got), column, got)
    np.testing.assert_allclose(got, brute_impute(x, 5), rtol=1e-9)


def test_impute_rounds_and_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, 4.04), (3, 2.0, 8.0)], "id int, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in I.impute_neighbors(df, "id", ["a", "b"]).collect()}
    assert got[1] == (1.5, 6.0) and got[2] == (1.0, 4.0)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_classify_matches_brute_force(spark, metric):
    rng = np.random.RandomState(1)
    x = rng.randint(-9, 10, size=(260, 4)).astype(float)  # exact distances, many ties
    y = (x.sum(axis=1) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, v array<double>, y int")
    train, test = df.filter("id >= 60"), df.filter("id < 60")
    got = {r["id"]: r["prediction"] for r in N.knn_classify(train, test, "id", "v", "y", 4, 5, "uniform", metric, block_rows=60).collect()}
    for i in range(60):
        d = np.abs(x[60:] - x[i])
        d = d.sum(axis=1) if metric == "manhattan" else np.sqrt((d * d).sum(axis=1))
        near = sorted(zip(d.round(9), range(60, 260)))[:5]
        votes = sum(y[j] for _, j in near)
        assert got[i] == (1 if votes >= 3 else 0)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_tree_and_boxes(metric):
    """Leaves hold every row once, are of near-equal size, and no row of a box is nearer than the box."""
    rng = np.random.RandomState(3)
    y = rng.normal(size=(3000, 3)) * [1, 5, 30]
    y[rng.uniform(size=y.shape) < 0.05] = np.nan
    tree = N.split_tree(y, 5)
    leaf = N.leaf_of(tree, y)
    sizes = np.bincount(leaf, minlength=32)
    assert sizes.sum() == 3000 and sizes.max() < 300
    boxes, members = [], []
    for cell in np.unique(leaf):
        part = y[leaf == cell]
        boxes.append(np.concatenate([[cell], np.nanmin(part, axis=0), np.nanmax(part, axis=0), np.isnan(part).any(axis=0)]))
        members.append(part)
    x = y[:60]
    lower = N.box_distances(boxes, x, metric)
    for k, part in enumerate(members):
        dist = np.nanmin(np.where(np.isnan(d := N._distances(x, part, metric)), np.inf, d), axis=1)
        assert (lower[:, k] <= (dist if metric == "manhattan" else dist**2) * (1 + 1e-9)).all()
    same = N.split_tree(np.ones((50, 3)), 3)
    assert same[0] == -1 and (N.leaf_of(same, np.ones((50, 3))) == 0).all()
    half = np.array([[1.0]] * 30 + [[0.0]] * 3)  # the median is the greatest value
    assert len(set(N.leaf_of(N.split_tree(half, 1), half).tolist())) == 2


def test_cells_are_small_and_few_pairs_are_met(spark):
    """Four times as many rows make far fewer than sixteen times as many pairs."""
    pairs = []
    for n in (2_000, 8_000):
        point = F.array(F.rand(1), F.rand(2)).alias("_y")
        donors = N._saved(spark.range(n).select(F.col("id").alias("_d"), point, F.lit(1.0).alias("_v")))
        rows, trees = N._grow(donors, 2, 100)
        sizes = rows.groupBy("_cell").count()
        assert sizes.agg(F.max("count")).first()[0] <= 100 and sizes.count() >= n / 100
        bound = donors.select(F.col("_d").alias("_q"), F.col("_y").alias("_x"), F.lit((5 / n) ** 0.5).alias("_bound"), F.lit(-1).cast("bigint").alias("_own"))
        asked = N.candidate_pairs(bound, N._boxes(rows, 2, len(trees)), 2, "euclidean")
        pairs.append(asked.join(sizes, "_cell").agg(F.sum("count")).first()[0])
    assert pairs[1] < 8 * pairs[0]


def test_all_rows_imputed_by_kind(spark):
    df = spark.range(60).select(
        F.col("id").cast("string").alias("row_key"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("bit"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 1.5).alias("size"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 3).cast("string")).alias("word"),
    )
    out = I.impute_all(df, "row_key")
    assert out.filter("bit is null or size is null or word is null").count() == 0


def test_pairs_leave_a_task_in_slices(spark, monkeypatch):
    """However many boxes a query row meets, no more than ``PAIRS`` rows are made at a time."""
    monkeypatch.setattr(N, "PAIRS", 6)
    made = []

    def with_cells(cells, rows, key, work, schema):
        numbers = [np.array([float(i), 0.0, 9.0, 1.0]) for i in range(3)]
        part = pd.DataFrame({"_q": range(10), "_x": [[1.0]] * 10, "_bound": [np.inf] * 10, "_own": [7] * 10, "_cell": [0] * 10})
        made.extend(work(numbers, part))
        return rows

    monkeypatch.setattr(N, "_with_cells", with_cells)
    N.candidate_pairs(spark.sql("select 1L as _q, array(1d) as _x, 1d as _bound, 7L as _own"), [None], 1, "euclidean")
    assert [len(m) for m in made] == [6] * 5
    assert sorted(pd.concat(made)["_cell"].tolist()) == [0] * 10 + [1] * 10 + [2] * 10


@pytest.mark.parametrize("kind", ["ties", "gaps", "far off", "infinite"])
def test_closest_is_what_all_distances_say(monkeypatch, kind):
    """The k nearest of a block, ties by order, are those of all distances; few pairs are measured one by one."""
    rng = np.random.RandomState(7)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(900, 3))
    if kind == "ties":
        x, y = x.round(), y.round()
    if kind == "far off":
        x, y = x + 1e6, y + 1e6
    if kind == "gaps":
        for m in (x, y):
            m[rng.uniform(size=m.shape) < 0.3] = np.nan
        x[0] = np.nan
    if kind == "infinite":
        y[3, 1] = np.inf
    allowed = rng.uniform(size=len(y)) < 0.5
    full = N._distances(x, y, "euclidean")
    want = np.where(allowed & np.isfinite(full), full, np.inf)
    measured, lengths = [], N._lengths
    monkeypatch.setattr(N, "_lengths", lambda diff, metric: measured.append(diff[..., 0].size) or lengths(diff, metric))
    for limit in (np.full(40, np.inf), np.sort(want, axis=1)[:, 6]):
        ((row, at, dist),) = N.closest(x, y, 5, "euclidean", limit, [(np.arange(40), allowed)])
        for i in range(40):
            best = [j for j in np.argsort(want[i], kind="stable")[:5] if np.isfinite(want[i, j])]
            assert at[row == i].tolist() == best and dist[row == i].tolist() == want[i, best].tolist()
    if kind in ("gaps", "far off"):
        assert sum(measured) < 2 * 40 * 60
    assert kind != "ties" or len(N._first_alike(y, 5)) < 600


def test_cuts_follow_the_coordinates_that_rows_have():
    y = np.random.RandomState(2).uniform(size=(400, 2)) * [100, 1]
    assert set(N.split_tree(y, 3)[:7]) == {0.0}
    assert set(N.split_tree(y, 3, np.array([0.0, 1.0]))[:7]) == {1.0}


def test_shares_of_known_coordinates(spark):
    rows = [("a", [1.0, None, float("nan")]), ("b", [1.0, 2.0, float("nan")])]
    assert N._known_shares(spark.createDataFrame(rows, "_q string, _x array<double>"), 3).tolist() == [1.0, 0.5, 0.0]


def test_imputed_set_reads_its_input_once(spark):
    """The plan of the filled table holds nothing of the plan of its input."""
    from wardtable.plans import modelling as MP

    df = spark.range(40).select(
        F.col("id").cast("string").alias("row_key"), F.when(F.col("id") % 9 != 0, F.col("id") * 1.5).alias("size"),
        (F.col("id") % 2).alias("sepsis"), F.uuid().alias("center"),
    )
    out = MP.imputed_set(df, 0.5)
    assert out.count() == 40 and "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
