"""Rows that meet at a rank of two hashes, and line items that are told apart by columns."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wardtable.operators import evaluate as E
from wardtable.operators import models as M
from wardtable.operators import search as S
from wardtable.operators.ordered import hash_number
from wardtable.plans import modelling as MP
from wardtable.registry import learning as RL


@pytest.fixture(scope="module")
def rows(spark):
    draw = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0) for k in range(3)]
    return spark.range(3000).select(
        F.concat(F.lit("k"), "id").alias("row_key"), array_to_vector(F.array(*draw)).alias("features"),
        F.when(F.col("id") % 50 != 0, (draw[0] + draw[1] / 3 > 0.6).cast("double")).alias("sepsis"),
    ).persist()


def _by_sorting(model, rows, features, repeats, seed=S.SEED):
    """Drops of F1 with whole columns sorted in one place."""
    taken = rows.select("sepsis", "features", *[hash_number(F.col("row_key"), F.lit(seed + s)).alias(f"h{s}") for s in range(repeats + 1)]).collect()
    spark, home = rows.sparkSession, sorted(taken, key=lambda r: r["h0"])

    def f1(x):
        df = spark.createDataFrame([(r["sepsis"], [float(c) for c in v]) for r, v in zip(home, x)], "sepsis double, a array<double>")
        scored = M.score_rows(model, df.select("sepsis", array_to_vector("a").alias("features")), "sepsis")
        return E.class_scores(scored, "sepsis", "prediction").first()["f1"]

    plain, out = f1([r["features"] for r in home]), {}
    for j, name in enumerate(features):
        drops = []
        for s in range(1, repeats + 1):
            away = sorted(taken, key=lambda r: r[f"h{s}"])
            drops.append(plain - f1([[*h["features"][:j], a["features"][j], *h["features"][j + 1 :]] for h, a in zip(home, away)]))
        out[name] = sum(drops) / repeats
    return out


@pytest.mark.parametrize("group_rows, ranges", [(200_000, 16), (300, 4), (60, 0.5), (100, 16)])
def test_permutations_are_those_of_whole_sorts(rows, monkeypatch, group_rows, ranges):
    """Many small groups, ranges wider than a group, and one group give the same permutations."""
    model = M.fit(rows.filter("sepsis is not null"), "logistic_regression", {}, "sepsis")
    monkeypatch.setattr(S, "ALIGNED_ROWS", group_rows)
    monkeypatch.setattr(S, "RANGES", ranges)
    found = S.permutation_importance(model, rows, ["a", "b", "c"], "row_key", "sepsis", 2)
    want = _by_sorting(model, rows, ["a", "b", "c"], 2)
    assert {r["feature"]: r["importance"] for r in found.collect()} == pytest.approx(want, abs=1e-12)


def test_permutations_take_one_shuffle_of_the_rows(rows):
    model = M.fit(rows.filter("sepsis is not null"), "decision_tree", {}, "sepsis")
    found = S.permutation_importance(model, rows, ["a", "b", "c"], "row_key", "sepsis", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and plan.count("_group#") and plan.count("REPARTITION_BY_NUM") == 1


def test_no_rows_have_no_importance(rows):
    model = M.fit(rows.filter("sepsis is not null"), "decision_tree", {}, "sepsis")
    assert S.permutation_importance(model, rows.limit(0), ["a", "b", "c"], "row_key", "sepsis", 2).collect() == []


def test_line_items_are_told_apart_as_their_texts_are(spark):
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double"
    keys = [
        (1, 1, 2, 3, 5.0), (1, 1, 2, 3, 5.0), (1, 1, 2, 4, 5.0), (1, 1, None, 3, 5.0), (1, 1, 3, None, 5.0), (None, 1, 1, 3, 5.0),
        (1, 1, 2, 3, None), (None, None, None, None, None), (None, None, None, None, None), (1, 1, 2, 3, 0.0), (1, 1, 2, 3, -0.0),
        (1, 1, 2, 3, float("nan")), (1, 1, 2, 3, float("nan")),
    ]
    table = spark.createDataFrame([(*k, 10.0, 0.1, 0.05) for k in keys], schema)
    want = {r[0] for r in table.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).collect()}
    lines = RL.lines_set(lambda name: table)
    found = [r[0] for r in lines.select(MP.KEY).collect()]
    assert len(found) == len(set(found)) == 8 and set(found) == want
    # Every row goes through one shuffle as it is; no task collects keys before it.
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]


def test_folds_take_one_shuffle_and_no_join_of_the_rows(rows):
    from wardtable.operators.split import stratified_folds

    dealt = stratified_folds(rows.select("row_key", F.coalesce("sepsis", F.lit(0.0)).alias("y"), F.rand(1).alias("x")), "row_key", "y", 3)
    assert dealt.count() == dealt.select("row_key").distinct().count() == 3000
    sizes = {(r["y"], r["fold"]): r["count"] for r in dealt.groupBy("y", "fold").count().collect()}
    for y in (0.0, 1.0):
        of = [sizes[y, k] for k in range(3)]
        assert max(of) - min(of) <= 1
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and plan.count("REPARTITION_BY_COL") == 1


def test_rows_with_one_key_take_every_rank_of_it(spark):
    """As the join of rows and ranks by key did: also without a key, and in different groups."""
    from wardtable.operators.ordered import hash_rank

    table = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("c", 1), ("a", 1), (None, 1), (None, 1), ("d", None)], "k string, g int")
    got = hash_rank(table, "k", 7, by=["g"], buckets=5)
    counts = {(r["k"], r["g"]): r["count"] for r in got.groupBy("k", "g").count().collect()}
    assert counts == {("a", 0): 6, ("a", 1): 3, ("b", 0): 1, ("c", 1): 1, (None, 1): 4, ("d", None): 1}
    assert {r["g"] for r in got.filter("rank is null").collect()} == {None}
    alone = hash_rank(table.filter("k in ('b', 'c', 'd')"), "k", 7, buckets=5)
    assert sorted(r["rank"] for r in alone.collect()) == [0, 1, 2]


def test_models_score_their_rows_once(spark, rows):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    scored = rows.filter("sepsis is not null").select(
        F.lit("m").alias("model"), "sepsis", F.col("sepsis").alias("prediction"), counted(F.rand(3) * 0 + F.col("sepsis")).alias("score")
    )
    n = scored.select("sepsis").count()
    row = E.compare_models(scored, "sepsis", "prediction", "score").first()
    assert read.value == n and row["f1"] == row["roc_auc"] == 1.0
