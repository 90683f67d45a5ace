"""Models by their invariants, searches by their bookkeeping."""

import pytest
from pyspark.sql import functions as F

from wardtable.operators import evaluate as E
from wardtable.operators import models as M
from wardtable.operators import search as S
from wardtable.plans import modelling as MP


@pytest.fixture(scope="module")
def data(spark):
    """Two informative features, one noise feature, a clean gap between the classes."""
    rows = spark.range(300).select(
        F.concat(F.lit("k"), "id").alias("row_key"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("noise"),
        (F.col("id") % 2).cast("int").alias("sepsis"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0).alias("u"),
    )
    return rows.select(
        "row_key", "noise", (F.col("sepsis") * 2 + F.col("u")).alias("signal"),
        (5 - F.col("sepsis") * 3 + F.col("u")).alias("other"), "sepsis",
    ).persist()


@pytest.fixture(scope="module")
def parts(data):
    return MP.prepare(data, folds=2)


CASES = [
    ("logistic_regression", {"C": 100, "penalty": "l1"}),
    ("random_forest", {"n_estimators": 5, "max_depth": None, "min_samples_split": 5}),
    ("decision_tree", {}),
    ("svc", {"kernel": "linear", "C": 10.0}),
    ("svc", {"kernel": "rbf", "C": 10.0, "gamma": "scale", "components": 32}),
    ("svc", {"kernel": "poly", "degree": 2, "coef0": 1.0}),
    ("bernoulli_bayes", {"binarize": 0.5, "fit_prior": False}),
    ("gradient_boosting", {"n_estimators": 3, "scale_pos_weight": 2, "reg_alpha": 1.0, "colsample_bytree": 0.7}),
    ("sgd_classifier", {"loss": "hinge", "alpha": 0.001, "early_stopping": True}),
    ("sgd_classifier", {"loss": "log_loss"}),
    ("knn_classifier", {"n_neighbors": 3, "weights": "distance", "leaf_size": 30}),
]


@pytest.mark.parametrize("family, params", CASES)
def test_separable_classes_are_separated(parts, family, params):
    model = M.fit(parts.train, family, params, "sepsis", "row_key")
    scored = M.score_rows(model, parts.test, "sepsis", ["row_key"]).persist()
    assert scored.count() == parts.test.count()
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1
    assert E.ranking_scores(scored, "sepsis", "score").first()["roc_auc"] == pytest.approx(1.0, abs=1e-3)
    assert E.class_scores(scored, "sepsis", "prediction").first()["f1"] > 0.97
    known = {"min_samples_split", "early_stopping", "leaf_size"}
    assert model.ignored == sorted(known & set(params))


def test_bad_names_fail_before_any_job(parts):
    with pytest.raises(ValueError):
        M.fit(parts.train, "random_forest", {"trees": 3}, "sepsis")
    with pytest.raises(ValueError):
        S.grid_candidates({"max_depth": 5})


def test_scaled_train_rows_span_zero_to_one(data):
    p = MP.prepare(data)
    from pyspark.ml.functions import vector_to_array

    v = p.train.select(vector_to_array("features").alias("v"))
    for i in range(3):
        assert tuple(v.agg(F.min(F.col("v")[i]), F.max(F.col("v")[i])).first()) == (0.0, 1.0)


def test_save_and_load(parts, tmp_path):
    model = M.fit(parts.train, "svc", {"kernel": "rbf", "components": 8, "gamma": 0.5}, "sepsis")
    model.save(str(tmp_path / "m"))
    again = M.load(str(tmp_path / "m"), "svc")
    a = {r[0]: r[3] for r in M.score_rows(model, parts.test, "sepsis", ["row_key"]).collect()}
    b = {r[0]: r[3] for r in M.score_rows(again, parts.test, "sepsis", ["row_key"]).collect()}
    assert a == b


def test_draws_repeat_and_stay_in_range():
    space = S.TRIAL_SPACES["gradient_boosting"]
    draws = S.random_candidates(space, 200)
    assert draws == S.random_candidates(space, 200) and draws != S.random_candidates(space, 200, seed=1)
    assert {d["max_depth"] for d in draws} == set(range(3, 16))
    assert all(0.01 <= d["learning_rate"] <= 0.2 and 0.6 <= d["subsample"] <= 1.0 for d in draws)


def test_search_tables(parts):
    grid = {"C": [0.001, 100.0], "penalty": ["l2"], "max_iter": [20]}
    summary, results = S.cv_search(parts.train, {"logistic_regression": grid}, "sepsis")
    rows = results.collect()
    assert len(rows) == 2 and sorted(r["rank"] for r in rows)[0] == 1
    best = summary.first()
    assert best["best_score"] == max(r["mean_f1"] for r in rows)
    assert all(0 <= r["mean_roc_auc"] <= 1 for r in rows)


def test_elimination_keeps_what_matters(parts):
    kept, path = S.eliminate_features(parts.train, parts.features, "logistic_regression", {"max_iter": 20}, "sepsis")
    assert "noise" not in kept and len(kept) >= 1
    assert [r["n_features"] for r in path.orderBy("n_features").collect()] == [1, 2, 3]


def test_permutation_importance_agrees_with_plain_shuffles(spark, parts):
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = M.fit(parts.train, "decision_tree", {}, "sepsis")
    rows = parts.train.select("sepsis", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), [r["sepsis"] for r in rows]

    def f1(m):
        df = spark.createDataFrame([(v, [float(c) for c in r]) for v, r in zip(y, m)], "sepsis double, a array<double>")
        scored = M.score_rows(model, df.select("sepsis", array_to_vector("a").alias("features")), "sepsis")
        return E.class_scores(scored, "sepsis", "prediction").first()["f1"]

    rng, want = np.random.RandomState(0), {}
    for j, name in enumerate(parts.features):
        drops = []
        for _ in range(3):
            shuffled = x.copy()
            shuffled[:, j] = shuffled[rng.permutation(len(x)), j]
            drops.append(f1(x) - f1(shuffled))
        want[name] = sum(drops) / 3
    found = S.permutation_importance(model, parts.train, parts.features, "row_key", "sepsis", 3).collect()
    assert {r["feature"] for r in found} == set(want)
    for r in found:
        assert r["importance"] == pytest.approx(want[r["feature"]], abs=0.06)


def test_trials_log_failures_and_survive(parts, tmp_path, spark):
    with pytest.raises(ValueError, match="kernel"):  # before any job
        S.run_trials(parts.train, parts.test, "svc", {"kernel": ["sigmoid"]}, 1, "sepsis")
    space = {"kernel": ["linear", "rbf"], "components": [-1], "C": S.Uniform(0.1, 1.0)}
    path = str(tmp_path / "log")
    log = S.run_trials(parts.train, parts.test, "svc", space, 5, "sepsis", log_path=path, threads=2)
    states = {r["state"] for r in log.collect()}
    assert states == {"COMPLETE", "FAIL"}
    assert spark.read.parquet(path).count() == 5
    done = S.complete_trials(log)
    assert done.filter("f1 is null or log_loss is null").count() == 0
    influence = S.parameter_influence(log).collect()
    assert {"kernel", "C"} <= {r["parameter"] for r in influence}


def test_experiment_and_saved_artefacts(data, tmp_path, spark):
    spaces = {"random_forest": {"n_estimators": S.IntRange(2, 5), "max_depth": S.IntRange(2, 4)}}
    run = MP.experiment(data, spaces, 2)
    row = run.comparison.first()
    assert row["model"] == "random_forest" and row["f1"] > 0.9
    run.save(str(tmp_path))
    assert MP.MinMax.load(spark, str(tmp_path / "scaler")).bounds == run.parts.scaler.bounds
    assert M.load(str(tmp_path / "random_forest_model")).transform(run.parts.test).count() > 0


def test_run_testing_report(data):
    out = MP.run_testing(data, {"logistic_regression": {"C": [1.0, 10.0]}}, folds=2, repeats=2)
    assert [r["row"] for r in out["report"].collect()] == ["0", "1", "accuracy", "macro avg", "weighted avg"]
    assert out["importance"].count() == 3 and out["cv_results"].count() == 2


def test_feature_selection_consensus(data):
    out = MP.select_features(data, {"decision_tree": {"max_depth": 3}, "logistic_regression": {"max_iter": 20}}, folds=2)
    assert out["metrics"].count() == 4
    assert "noise" not in {r[0] for r in out["consensus"].collect()}


def test_components_are_centred_and_repeatable(data):
    scores, shares = M.principal_components(data, ["noise", "signal", "other"], 2, ["row_key"])
    m = scores.agg(F.avg("PC1"), F.avg("PC2")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1]) < 1e-9 and shares[0] > shares[1] > 0
    assert M.principal_components(data, ["noise", "signal", "other"], 2)[1] == pytest.approx(shares)


def test_ties_in_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.5)] * 5 + [(0, 1, 0.5)] * 5, "y int, p int, s double")
    assert E.ranking_scores(df, "y", "s").first()["roc_auc"] == 0.5
    one = df.filter("y = 1")
    assert E.ranking_scores(one, "y", "s").first()["roc_auc"] is None
    assert E.class_scores(one.withColumn("p", F.lit(0)), "y", "p").first()["precision"] == 0.0


def test_imputed_set_has_no_gaps(spark):
    df = spark.range(120).select(
        F.col("id").cast("string").alias("row_key"),
        F.when(F.col("id") % 20 != 0, F.col("id") * 1.5).alias("plaquetas"),
        F.when(F.col("id") % 3 != 0, 1.0).alias("mostly_missing"),
        F.when(F.col("id") % 30 != 0, F.col("id") % 2).alias("bit"),
        F.when(F.col("id") % 2 == 0, "True").alias("mujer_gestante"),
        (F.col("id") % 2).cast("double").alias("tipo_cancer_1.0"),
        F.lit(5).alias("center"),
        (F.col("id") % 3 == 0).cast("int").alias("sepsis"),
    ).drop("mujer_gestante").withColumn("mujer_gestante", F.lit("True"))
    out = MP.imputed_set(df)
    assert set(out.columns) == {"row_key", "plaquetas", "bit", "mujer_gestante", "tumores", "sepsis"}
    assert out.dropna().count() == 120


def test_own_objective_and_refit_from_a_saved_log(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_key bigint, a double, b double, sepsis int")

    def objective(params):
        if params["C"] > 6:
            raise ValueError("too large")
        return params["C"], -params["C"]

    log = S.run_trials(df, df, "logistic_regression", {"C": S.Uniform(0.1, 9.9)}, 8, "sepsis", objective=objective)
    done = [r for r in log.collect() if r["state"] == "COMPLETE"]
    assert done and len(done) < 8 and all(r["f1"] == -r["log_loss"] for r in done)
    saved = MP.save_tables({"log": log}, str(tmp_path))["log"]
    out = MP.refit_from_log(df, saved)
    assert out["chosen"].first()["f1"] == max(r["f1"] for r in done)
    counts = out["confusion"].first()
    assert counts["tp"] + counts["tn"] > 0 and out["report"].count() == 5


def test_selected_set(spark):
    columns = ["row_key", "sepsis", "other", *MP.SELECTED]
    full, gap = [1.0] * len(MP.SELECTED), [None] + [2.0] * (len(MP.SELECTED) - 1)
    df = spark.createDataFrame([("a", 1, 9.0, *full), ("b", 0, None, *full), ("c", 0, 9.0, *gap)], columns)
    kept = MP.selected_set(df)
    assert kept.columns == ["row_key", *MP.SELECTED, "sepsis"]
    assert sorted(r[0] for r in kept.select("row_key").collect()) == ["a", "b"]
    filled = MP.selected_set(df, impute=True)
    assert filled.count() == 3 and MP.C.drop_incomplete_rows(filled).count() == 3
    with pytest.raises(ValueError, match="edad"):
        MP.selected_set(df.drop("edad"))
