"""Bernoulli likelihoods from counts, parts from the digits of a hash, and line items compared in tasks of bounded size."""

import hashlib

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import Binarizer
from pyspark.sql import functions as F

from wardtable.operators import models as M
from wardtable.operators import split as P
from wardtable.plans import modelling as MP
from wardtable.registry import learning as RL


@pytest.fixture(scope="module")
def data(spark):
    cells = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10 + k)) / 10.0).alias(c) for k, c in enumerate("abcd")]
    label = (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)) == 0).cast("int").alias("sepsis")
    return spark.range(500).select(F.concat(F.lit("k"), "id").alias("row_key"), *cells, label)


def test_counts_teach_what_all_rows_do(data, monkeypatch):
    df = M.assemble(data, list("abcd"), "sepsis", ["row_key"])
    old = Pipeline(stages=[
        Binarizer(threshold=0.4, inputCol="features", outputCol="binary"),
        NaiveBayes(featuresCol="binary", labelCol="sepsis", modelType="bernoulli", smoothing=0.5),
    ]).fit(df)
    learnt = []
    fit = NaiveBayes.fit
    monkeypatch.setattr(M.NaiveBayes, "fit", lambda self, rows, *more: (learnt.append(rows.count()), fit(self, rows, *more))[1])
    new = M.fit(df, "bernoulli_bayes", {"alpha": 0.5, "binarize": 0.4}, "sepsis")
    assert learnt and learnt[0] <= 2 * 5  # the rows themselves are only counted
    assert new.model.stages[1].theta.toArray().tolist() == old.stages[1].theta.toArray().tolist()
    assert new.model.stages[1].pi.toArray().tolist() == old.stages[1].pi.toArray().tolist()
    take = lambda m: sorted(map(str, m.transform(df).select("row_key", "prediction", "probability").collect()))
    assert take(new) == take(old)


def test_bits_of_odd_values(spark, tmp_path):
    """NaN and the threshold itself are no bits; a missing value is an error."""
    rows = [(1, [0.5, float("nan")]), (0, [0.6, 0.5]), (0, [float("inf"), -1.0]), (1, [0.4, 0.7])]
    df = spark.createDataFrame(rows, "y int, v array<double>").select("y", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    ready = M.assemble(df, ["a", "b"], "y", ["a", "b"])
    model = M.fit(ready, "bernoulli_bayes", {"binarize": 0.5, "fit_prior": False}, "y")
    bits = [[int(v) for v in r["binary"]] for r in model.transform(ready).collect()]
    assert bits == [[0, 0], [1, 0], [1, 0], [0, 1]]
    model.save(str(tmp_path / "m"))
    take = lambda m: M.score_rows(m, ready, "y").collect()
    assert take(M.load(str(tmp_path / "m"), "bernoulli_bayes")) == take(model)
    holes = M.assemble(df.unionByName(df.withColumn("b", F.lit(None).cast("double"))), ["a", "b"], "y")
    with pytest.raises(Exception):
        M.fit(holes, "bernoulli_bayes", {}, "y")


def test_large_parts_score_as_small_ones(data, monkeypatch):
    def scored():
        parts = MP.prepare(data)
        model = M.fit(parts.train, "bernoulli_bayes", {"fit_prior": False}, "sepsis")
        return sorted(map(str, M.score_rows(model, parts.test, "sepsis", ["row_key"]).collect()))

    want = scored()
    monkeypatch.setattr(MP, "KEPT_CELLS", 10)
    assert scored() == want


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_digits_of_a_hash_compare_as_its_number(spark, share):
    keys = spark.range(300).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("k"))
    got = keys.select("k", P.in_test(F.col("k"), share), P.part_of(F.col("k"), share / 2, share / 2)).collect()
    for k, t, p in got:
        h = int(hashlib.md5("|".join([*([] if k is None else [k]), str(P.SEED)]).encode()).hexdigest()[:15], 16)
        bound, half = int(share * (1 << 60)), int(share / 2 * (1 << 60))
        assert t == (h < bound) and p == (0 if h < half else 1 if share and h < bound else 2)
    plan = keys.select(P.part_of(F.col("k")))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan


def test_a_task_compares_a_bounded_number_of_line_items(spark, monkeypatch):
    half = F.floor(F.col("id") / 2)
    lines = spark.range(4000).select(
        half.alias("l_orderkey"), (half % 4).cast("int").alias("l_linenumber"), (half % 7).alias("l_partkey"), (half % 3).alias("l_suppkey"),
        (half + 0.5).alias("l_extendedprice"), (half % 50).cast("double").alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.lit(0.05).alias("l_tax"),
    )
    want = sorted(map(str, RL.lines_set(lambda name: lines).collect()))
    monkeypatch.setattr(RL, "LINES_PER_TASK", 100)
    dealt = RL.lines_set(lambda name: lines)
    assert sorted(map(str, dealt.collect())) == want and len(want) == 2000
    sizes = dealt.groupBy(F.spark_partition_id().alias("task")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
