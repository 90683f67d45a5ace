"""Feature maps against their kernels, and probabilities of machines."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from wardtable.operators import models as M


def mapped(spark, x, **params):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "i int, x array<double>").select("i", array_to_vector("x").alias("features"))
    out = M.PolynomialMap(**params).transform(df).select("i", vector_to_array("mapped").alias("m")).orderBy("i").collect()
    return np.array([r["m"] for r in out])


@pytest.mark.parametrize("degree, coef0", [(1, 0.0), (2, 1.5), (3, 0.5), (3, 0.0)])
def test_few_monomials_give_the_kernel_itself(spark, degree, coef0):
    x = np.random.RandomState(1).normal(size=(20, 4))
    m = mapped(spark, x, gamma=0.7, coef0=coef0, degree=degree, components=512)
    assert np.allclose(m @ m.T, (0.7 * x @ x.T + coef0) ** degree)


def test_sketch_has_a_fixed_width_and_an_error_that_falls(spark):
    x = np.random.RandomState(2).normal(size=(40, 60)) / math.sqrt(60)
    want = (x @ x.T + 1.0) ** 3
    errors = []
    for size in (64, 1024, 8192):
        m = mapped(spark, x, gamma=1.0, coef0=1.0, degree=3, components=size)
        assert m.shape[1] == size
        errors.append(float(np.sqrt(((m @ m.T - want) ** 2).mean()) / want.std()))
    assert errors[2] < errors[1] < errors[0] and errors[2] < 0.5
    with pytest.raises(ValueError):
        M.PolynomialMap(coef0=-1.0)


def test_poly_machine_learns_what_a_line_cannot(spark):
    """Inside a ring against outside."""
    rng = random.Random(3)
    rows = [(str(i), [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(400)]
    df = spark.createDataFrame([(k, x, float(x[0] ** 2 + x[1] ** 2 < 0.5)) for k, x in rows], "k string, x array<double>, y double")
    df = df.select("k", array_to_vector("x").alias("features"), "y").coalesce(1).persist()
    share = {}
    for kernel in ("linear", "poly"):
        params = {"kernel": kernel, "degree": 2, "coef0": 1.0, "gamma": 1.0, "C": 100.0, "max_iter": 15}
        scored = M.score_rows(M.fit(df, "svc", params, "y", "k"), df, "y")
        share[kernel] = scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert share["poly"] > 0.95 > 0.8 > share["linear"]


def test_probability_of_unseen_margins_is_calibrated(spark):
    """Many noise features and few rows: margins of seen rows are far too sure, those of other parts are not."""
    rng = np.random.RandomState(4)
    x = rng.normal(size=(1200, 60))
    y = (rng.uniform(size=1200) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    rows = [(str(i), x[i].tolist(), float(y[i])) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, x array<double>, y double").select("k", array_to_vector("x").alias("features"), "y")
    train, test = df.filter("cast(k as int) < 200").coalesce(1).persist(), df.filter("cast(k as int) >= 200")
    model = M.fit(train, "svc", {"kernel": "linear", "C": 10.0, "max_iter": 30}, "y", "k")
    scores = M.score_rows(model, test, "y").select("y", "score").collect()
    p, t = np.array([r["score"] for r in scores]), np.array([r["y"] for r in scores])
    machine = model.model.stages[0]
    own = M.LogisticRegression(featuresCol="margin", labelCol="y", standardization=False).fit(machine.transform(train).select("margin", "y"))
    sure = np.array([r[0] for r in own.transform(machine.transform(test).select("margin", "y")).select(vector_to_array("probability")[1]).collect()])

    def loss(q):
        q = np.clip(q, 1e-12, 1 - 1e-12)
        return float(-(t * np.log(q) + (1 - t) * np.log(1 - q)).mean())

    assert loss(p) < 0.8 * loss(sure)
    for low, high in ((0.0, 0.5), (0.5, 1.0)):
        part = (p >= low) & (p < high)
        assert abs(p[part].mean() - t[part].mean()) < 0.12
