"""What fits read: written parts with short plans, and memory that doesn't follow the size of a table."""

import pytest
from pyspark.sql import functions as F

from wardtable.operators import models as M
from wardtable.operators import selection as L
from wardtable.plans import modelling as MP


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.range(400).select(
        F.concat(F.lit("k"), "id").alias("row_key"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0).alias("b"),
        (F.col("id") % 2).cast("int").alias("sepsis"),
    )
    other = rows.select("row_key", (F.col("a") + 2 * F.col("sepsis")).alias("c"))
    return rows.groupBy("row_key").agg(*[F.max(c).alias(c) for c in ("a", "b", "sepsis")]).join(other, "row_key")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_fits_do_not_carry_the_plan_of_the_data_set(data):
    parts = MP.prepare(data, validation=0.2)
    for part in (parts.train, parts.test, parts.validation):
        plan = part._jdf.queryExecution().optimizedPlan().toString() + part._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and part.count() > 0


def test_large_parts_are_not_kept_and_have_the_same_rows(data, monkeypatch):
    kept = MP.prepare(data, folds=3)
    monkeypatch.setattr(MP, "KEPT_CELLS", 10)
    read = MP.prepare(data, folds=3)
    assert not read.train.storageLevel.useMemory and not read.test.storageLevel.useMemory
    assert _rows(kept.train) == _rows(read.train) and _rows(kept.test) == _rows(read.test)


@pytest.mark.parametrize("family, params", [
    ("svc", {"kernel": "rbf", "gamma": "scale", "components": 16, "max_iter": 10}),
    ("svc", {"kernel": "poly", "degree": 2, "coef0": 1.0, "max_iter": 10}),
    ("sgd_classifier", {"loss": "hinge", "alpha": 0.001, "max_iter": 10}),
])
def test_machines_fitted_one_by_one_score_the_same(spark, data, monkeypatch, family, params):
    parts = MP.prepare(data)
    together = M.score_rows(M.fit(parts.train, family, params, "sepsis", "row_key"), parts.test, "sepsis", ["row_key"])
    held = []
    fit = M.LinearSVC.fit

    def watched(self, df, *more):
        held.append(df.storageLevel.useMemory)
        return fit(self, df, *more)

    monkeypatch.setattr(M.LinearSVC, "fit", watched)
    monkeypatch.setattr(M, "TOGETHER_CELLS", 10)
    single = M.score_rows(M.fit(parts.train, family, params, "sepsis", "row_key"), parts.test, "sepsis", ["row_key"])
    assert held == [False] * 4
    for a, b in zip(sorted(together.collect()), sorted(single.collect()), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-6)


def test_a_log_without_results_has_no_front(spark):
    log = spark.createDataFrame([(1, None, 0.5), (2, None, 0.4)], "trial_id int, f1 double, log_loss double")
    assert L.first_of_front(log, "f1", "log_loss", "trial_id").first() is None
