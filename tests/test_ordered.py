"""Bucketed running totals, ranks and quantiles against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardtable.operators import ordered as O
from wardtable.operators import quantiles as Q
from wardtable.operators import selection as L
from wardtable.operators import split as P
from wardtable.operators import stats as S


@pytest.mark.parametrize("buckets", [2, 7, 50])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(spark, buckets, descending, exclusive):
    rnd = random.Random(buckets)
    data = [(g, float(v), rnd.randint(0, 9)) for g in "ab" for v in rnd.sample(range(-500, 500), 80)]
    df = spark.createDataFrame(data, "g string, v double, n int")
    got = O.running(
        df, "v", {"s": ("sum", "n"), "top": ("max", "n"), "low": ("min", "n")},
        by=["g"], descending=descending, buckets=buckets, exclusive=exclusive,
    ).collect()
    assert len(got) == len(data)
    for r in got:
        before = [
            n for g, v, n in data
            if g == r["g"] and ((v > r["v"]) if descending else (v < r["v"]) or False) or (g == r["g"] and v == r["v"] and not exclusive)
        ]
        assert r["s"] == sum(before)
        assert r["top"] == (max(before) if before else None)
        assert r["low"] == (min(before) if before else None)


def test_hash_rank_is_a_permutation_inside_each_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    got = O.hash_rank(df, "id", 1, by=["g"], buckets=13).collect()
    for g, n in (("hot", 900), ("cold", 100)):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(n))


def test_split_parts_are_disjoint_complete_and_exact(spark):
    df = spark.range(1001)
    for exact in (False, True):
        train, test = P.split(df, "id", 0.3, exact=exact)
        a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
        assert not a & b and len(a | b) == 1001
        if exact:
            assert len(b) == 301
    again = {r[0] for r in P.split(df, "id", 0.3)[1].collect()}
    assert again == {r[0] for r in P.split(df.repartition(5), "id", 0.3)[1].collect()}


def test_folds_are_stratified(spark):
    df = spark.range(997).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    counts = P.stratified_folds(df, "id", "y").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("kind", ["uniform", "ties", "hot", "lognormal", "two"])
def test_large_quantiles_are_exact(spark, kind):
    rng = np.random.RandomState(3)
    x = {
        "uniform": rng.uniform(-5, 5, 4001),
        "ties": rng.randint(0, 7, 4000).astype(float),
        "hot": np.where(rng.uniform(size=4000) < 0.4, 3.25, rng.normal(size=4000) * 1e6),
        "lognormal": rng.lognormal(0, 4, 3999),
        "two": np.array([1.0, 2.0] * 11),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.exact_quantiles(df, ["x"], shares, read_limit=280)["x"]
    assert got == pytest.approx(list(np.quantile(x, shares)), rel=1e-12)
    assert Q.exact_quantiles(df, ["x"], shares)["x"] == pytest.approx(list(np.quantile(x, shares)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert Q.exact_quantiles(df, ["x"], [0.5])["x"] == [None]
    assert Q.exact_quantiles(df, [], [0.5]) == {}


def test_tied_quartiles(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 1.0, 1.0, 2.0, 9.0, None]], "x double")
    got = {r["x"]: r["x_recoded"] for r in S.quantile_recode(df, ["x"]).collect()}
    # quartiles 1, 1, 1, 1.75, 9 -> edges 1, 1.75, 9
    assert got == {1.0: 0, 2.0: 1, 9.0: 1, None: None}
    with pytest.raises(ValueError):
        S.quantile_recode(df, ["x"], on_ties="error")


def test_outliers_become_missing(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 21), 1000]] + [(None,)], "x double")
    out = S.outliers_and_quartiles(df, ["x", "absent"])
    assert out.filter("x = 1000").count() == 0 and out.filter("x is null and x_recoded is null").count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_pareto_matches_pairwise(spark, seed):
    rnd = random.Random(seed)
    data = [(i, rnd.randint(0, 12), rnd.randint(0, 12)) for i in range(120)]
    df = spark.createDataFrame(data, "i int, a int, b int")
    got = {r["i"] for r in L.pareto_front(df, "a", "b").collect()}
    want = {
        i for i, a, b in data if not any((x >= a and y <= b) and (x > a or y < b) for _, x, y in data)
    }
    assert got == want


def test_consensus(spark):
    df = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "b"), ("n", "c"), ("o", "b"), ("o", "b")], "m string, f string")
    assert [r["f"] for r in L.consensus(df, "f", "m").collect()] == ["b"]


def test_frequent_values_have_the_same_ranks(spark, monkeypatch):
    from wardtable.operators import ordered

    df = spark.range(200).select(
        F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("double")).alias("few"), (F.col("id") * 37 % 101).cast("double").alias("many"),
        F.lit(None).cast("double").alias("none"),
    )
    want = sorted(str(r) for r in ordered.average_ranks(df, ["few", "many", "none"]).collect())
    monkeypatch.setattr(ordered, "OFTEN", 20)
    got = ordered.average_ranks(df, ["few", "many", "none"])
    assert sorted(str(r) for r in got.collect()) == want
    assert "None" in want[0] and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_quantiles_of_repeated_values_take_two_passes(spark, monkeypatch):
    rng = np.random.RandomState(4)
    x, y = rng.randint(0, 60, 5000).astype(float), rng.normal(size=5000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, float("nan"))], "x double, y double").repartition(4)
    monkeypatch.setattr(Q, "_halve", None)  # halving a bracket of ties took a pass for each target
    shares = [0, 0.25, 0.5, 0.75, 1]
    got = Q.exact_quantiles(df, ["x", "y"], shares, read_limit=200)
    assert got == {"x": list(np.quantile(x, shares)), "y": pytest.approx(list(np.quantile(y, shares)), rel=1e-12)}


def test_measured_table_is_made_once(spark):
    df = spark.createDataFrame([(i, float(i % 9)) for i in range(60)] + [(60, 500.0), (61, None)], "k int, x double")
    out = S.outliers_and_quartiles(df, ["x"])
    assert out.inputFiles() and all("/measured-" in f for f in out.inputFiles())
    assert out.dtypes == [("k", "int"), ("x", "double"), ("x_recoded", "int")] and out.filter("x_recoded is null").count() == 2
