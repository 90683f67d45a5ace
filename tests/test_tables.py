"""Joins, pivots, fills and column rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardtable.operators import columns as C
from wardtable.operators import impute as I
from wardtable.operators import joins as J
from wardtable.operators import reshape as R
from wardtable.operators import stats as S
from wardtable.operators.scaling import MinMax


def test_pivot_drops_null_keys_and_items_and_fills_with_zero(spark, rows):
    df = spark.createDataFrame(
        [("p", "a", 2.0), ("p", "b", None), ("p", "a", 3.0), (None, "a", 9.0), ("q", None, 9.0), ("r", "b", 1.0)],
        "k string, item string, v double",
    )
    wide = R.pivot_sum(df, ["k"], "item", F.col("v"))
    assert wide.columns == ["k", "a", "b"]
    assert rows(wide) == [("p", 5.0, 0.0), ("r", 0.0, 1.0)]
    total = wide.agg(F.sum(F.col("a") + F.col("b"))).first()[0]
    assert total == 6.0


def test_pivot_refuses_too_many_columns(spark):
    df = spark.range(20).select(F.lit(1).alias("k"), F.col("id").alias("item"))
    with pytest.raises(ValueError):
        R.level_values(df, "item", cap=10)


def test_one_hot_keeps_float_codes_and_null_is_false(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "i int, c double")
    wide = R.one_hot(df, ["c"])
    assert wide.columns == ["i", "c_1.0", "c_3.0"]
    assert rows(wide.select("i", C.col("c_1.0"), C.col("c_3.0"))) == [(1, True, False), (2, False, True), (3, False, False)]


def test_weights_sum_to_one_and_explode_keeps_everyone(spark, rows):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, None), (3, [])], "p int, r array<string>")
    out = R.row_weight(R.explode_list(df, "r"), "p")
    assert {r["p"] for r in out.collect()} == {1, 2, 3}
    for r in out.groupBy("p").agg(F.sum("weight").alias("w")).collect():
        assert r["w"] == pytest.approx(1.0)
    assert rows(out, "p", "co_infection") == [(1, 1), (1, 1), (1, 1), (2, 0), (3, 0)]


def test_lookup_default_only_for_unknown_codes(spark, rows):
    names = spark.createDataFrame([("1", "_Virus"), ("1", "Escherichia coli"), ("2", None)], "code string, label string")
    df = spark.createDataFrame([("1",), ("2",), ("9",), (None,)], "c string")
    out = J.lookup(df, F.col("c"), names, "code", "label", "l", default="NEGATIVE")
    assert rows(out) == [("1", "Escherichia coli"), ("2", None), ("9", "NEGATIVE"), (None, "NEGATIVE")]
    out = J.lookup(df, F.col("c"), names, "code", "label", "l")
    assert rows(out) == [("1", "Escherichia coli"), ("2", None), ("9", None), (None, None)]


def test_codes_to_names_with_renamed_variable(spark, rows):
    codes = spark.createDataFrame(
        [("f", "old", "1.0", "one", 0), ("f", "old", "2", "two", 0), ("f", "gone", "1", "x", 0), ("g", "old", "3", "three", 0),
         ("f", "old", None, "none", 0)],
        "form string, variable string, value string, name string, recode int",
    )
    df = spark.createDataFrame([(1, "1"), (2, "2.0"), (3, "3"), (4, None)], "i int, new string")
    out, errors = J.codes_to_names(df, codes, "f", alias={"old": "new"})
    assert rows(out) == [(1, "one"), (2, "two"), (3, None), (4, None)]
    assert rows(errors, "variable", "problem", "n") == [("gone", "no such column", None), ("old", "value without a name", 1)]
    same, none = J.codes_to_names(df, codes, "absent")
    assert same is df and none.count() == 0


def test_collision_suffixes_and_person_fanout(spark, rows):
    left = spark.createDataFrame([(1, "a", 10), (1, "b", 20)], "p int, adm string, v int")
    right = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "p int, adm string, v int")
    both = J.join_with_suffixes(left, right, ["p"])
    assert set(both.columns) == {"p", "adm_x", "v_x", "adm_y", "v_y"} and both.count() == 4
    assert J.join_person(left, right, "p", "adm", on_admission=False).count() == 4
    assert rows(J.join_person(left, right, "p", "adm", on_admission=True), "adm", "v_x", "v_y") == [("a", 10, 1), ("b", 20, 2)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_join_as_any_other(spark, rows, how):
    left = spark.createDataFrame([(1, i) for i in range(90)] + [(2, 0), (3, 0), (None, 0), (4, 0), (4, 0)], "k int, a int")
    right = spark.createDataFrame([(1, 0), (1, 1), (5, 0), (None, 9)] + [(2, i) for i in range(60)], "k int, b int")
    plain = rows(left.join(right, "k", how))
    assert rows(J.balanced_join(left, right, ["k"], how)) == plain
    two = [d.withColumn("j", F.lit("x")) for d in (left, right)]
    assert rows(J.balanced_join(*two, ["k", "j"], how), "k", "a", "b") == plain
    unique = right.dropDuplicates(["k"])
    assert rows(J.balanced_join(left, unique, ["k"], how, right_unique=True)) == rows(left.join(unique, "k", how))


def test_null_keys_match_only_on_request(spark):
    a = spark.createDataFrame([(None, 1)], "k int, x int")
    b = spark.createDataFrame([(None, 2)], "k int, y int")
    assert J.join_with_suffixes(a, b, ["k"]).first()["y"] is None
    assert J.join_with_suffixes(a, b, ["k"], null_keys_match=True).first()["y"] == 2


def test_fill_by_type(spark):
    df = spark.createDataFrame([(None, None, None, None)], "n int, b boolean, s string, d date")
    assert tuple(C.fill_missing(df, False).first()) == (0, False, "False", None)
    assert tuple(C.fill_missing(df, 0, only=["n"]).first()) == (0, None, None, None)


def test_sparse_limit_is_strict(spark):
    df = spark.createDataFrame([(None if i == 0 else i, None if i < 2 else i) for i in range(10)], "ten int, twenty int")
    kept, report = C.drop_sparse_columns(df, 0.1)
    assert kept.columns == ["ten"]
    assert {r["column"]: r["dropped"] for r in report.collect()} == {"ten": False, "twenty": True}


def test_combine_truncates_and_skips_nulls(spark):
    df = spark.createDataFrame([(1.9, None, 5), (-1.5, -0.4, 6)], "a_cancer double, b_cancer double, x int")
    out = C.combine_columns(df, C.columns_like(df, "cancer"), "tumores")
    assert out.columns == ["x", "tumores"] and [tuple(r) for r in out.collect()] == [(5, 1), (6, -1)]


def test_column_classes(spark):
    df = spark.range(400).select(
        (F.col("id") % 2).alias("bit"), F.when(F.col("id") > 3, F.col("id") % 14).alias("few"),
        (F.col("id") % 15).alias("fifteen"), F.col("id").alias("many"), F.lit("t").alias("word"),
    )
    assert C.classify_columns(df) == {
        "binary": ["bit"], "levels": ["few"], "continuous": ["fifteen", "many"], "text": ["word"],
    }


def test_strict_drop(spark):
    df = spark.range(1)
    assert C.drop_columns(df, ["nope"]).columns == ["id"]
    with pytest.raises(KeyError):
        C.drop_columns(df, ["nope"], strict=True)


def test_mean_gap(spark, rows):
    d = dt.date
    df = spark.createDataFrame([(1, d(2024, 1, 1)), (1, d(2024, 1, 1)), (1, d(2024, 1, 5)), (1, d(2024, 1, 11)), (2, d(2024, 1, 1))], "p int, day date")
    assert rows(S.mean_gap(df, ["p"], "day", "gap")) == [(1, 5.0), (2, None)]


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "b"), (9, "a"), (None, None)], "n int, s string")
    assert I.most_frequent(df, ["n", "s"]) == {"n": 9.0, "s": "a"}
    assert tuple(I.impute_most_frequent(df, ["n"]).filter("s is null").first()) == (9, None)


def test_scaler_learns_on_train_only(spark):
    train = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "x double, same double")
    test = spark.createDataFrame([(20.0, 6.0)], "x double, same double")
    scaler = MinMax.fit(train, ["x", "same"])
    assert [tuple(r) for r in scaler.transform(train).orderBy("x").collect()] == [(0.0, 0.0), (1.0, 0.0)]
    assert tuple(scaler.transform(test).first()) == (2.0, 0.0)


def test_drop_correlated_keeps_the_earlier(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), (-F.col("id")).alias("c"), F.expr("id % 7").alias("d"))
    kept, pairs = S.drop_correlated(df, 0.95)
    assert kept.columns == ["a", "d"] and {r["dropped"] for r in pairs.collect()} == {"b", "c"}


def test_spearman(spark):
    df = spark.range(1, 40).select(F.col("id").alias("a"), F.expr("id * id * id").alias("b"))
    assert S.correlations(df, ["a", "b"], "spearman").first()["r"] == pytest.approx(1.0)


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select(F.expr("(id % 97) / 97.0").cast("double").alias("x"))
    d = S.density(df, "x", bins=400, grid=400, bandwidth=0.01).collect()
    step = (96 / 97) / 399
    assert sum(r["density"] for r in d) * step == pytest.approx(1.0, abs=0.05)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_joins_hold_for_many_hot_keys_equal_rows_and_nulls(spark, rows, how):
    left = spark.range(3000).select((F.col("id") % 300).alias("k"), F.lit("same").alias("a"))
    left = left.unionByName(spark.range(500).select(F.lit(None).cast("bigint").alias("k"), F.lit("none").alias("a")))
    right = spark.range(900).select((F.col("id") % 450).alias("k"), F.col("id").alias("b"))
    spark.sparkContext.setJobGroup("joins", "joins")
    joined = J.balanced_join(left, right, ["k"], how)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("joins")
    spark.sparkContext.setJobGroup("other", "other")
    assert rows(joined, "k", "a", "b") == rows(left.join(right, "k", how), "k", "a", "b")


def test_nan_counts_as_missing(spark, rows):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, 0.0), (1, 2.0, 1.0), (2, None, nan), (2, -4.0, None)], "k int, v double, b double")
    assert rows(S.any_positive(df.filter("k = 2 or isnan(v)"), ["k"], "v", "p")) == [(1, False), (2, False)]
    assert C.drop_incomplete_rows(df).count() == 1
    assert rows(C.fill_missing(df, 0), "v") == [(-4.0,), (0.0,), (0.0,), (2.0,)]
    assert C.classify_columns(df)["binary"] == ["b"]
    assert C.drop_low_variance(df)[0].columns == ["k", "v", "b"]
    assert sum(r["n"] for r in S.histogram(df, "v", 3).collect()) == 2


def test_charts_of_columns_without_values(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2)], "x double, y double, hue int")
    assert S.histogram(df, "x", 4).count() == 0
    assert S.pair_bins(df, ["x", "y"], "hue").count() == 0
    assert S.density(df, "x").count() == 0


def test_correlations_use_rows_with_both_values(spark):
    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(1)
    data = pd.DataFrame(draw.normal(size=(60, 5)), columns=list("abcde"))
    data["e"] = 1.0
    data = data.mask(draw.random(data.shape) < 0.2)
    data["d"] = data["d"].where(data["a"].isna())  # never there together with a
    df = spark.createDataFrame(data)
    got = {(r["column_a"], r["column_b"]): r["r"] for r in S.correlations(df, list("abcde")).collect()}
    want = data.corr()
    assert len(got) == 10
    for (a, b), r in got.items():
        assert (r is None) if pd.isna(want.loc[a, b]) else r == pytest.approx(want.loc[a, b])
    got = {(r["column_a"], r["column_b"]): r["r"] for r in S.correlations(df, list("abcde"), "spearman").collect()}
    want = data.rank().corr()
    for (a, b), r in got.items():
        assert (r is None) if pd.isna(want.loc[a, b]) else r == pytest.approx(want.loc[a, b])
    assert S.correlations(df, ["a"]).count() == 0 and S.correlations(df.limit(0), ["a", "b"]).first()["r"] is None


def test_moments_of_many_columns_and_large_means(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from wardtable.operators import gram

    monkeypatch.setattr(gram, "BLOCK", 7)
    monkeypatch.setattr(gram, "FIRST_ROUND", 3)
    draw = np.random.default_rng(2)
    data = pd.DataFrame(draw.normal(size=(900, 20))).add_prefix("c")
    data["c1"] = data["c0"] * 0.5 + data["c1"]
    data["c3"] = 1e9 + data["c0"] + data["c3"]  # the mean is a billion times the spread
    data["c4"] = 123456.789
    data.loc[draw.random(900) < 0.3, "c5"] = np.nan
    df = spark.createDataFrame(data).repartition(11)
    got = {(r["column_a"], r["column_b"]): r["r"] for r in S.correlations(df, list(data.columns)).collect()}
    want = (data - data.mean()).corr()
    assert len(got) == 190
    for (a, b), r in got.items():
        assert r is None if "c4" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-7)
    rows = {(r["i"], r["j"]): r["n"] for r in gram.pair_moments(df, [F.col(c) for c in data.columns]).collect()}
    assert rows[0, 1] == 900 and rows[0, 5] == data["c5"].notna().sum()


def test_average_ranks(spark):
    import numpy as np
    import pandas as pd

    from wardtable.operators.ordered import average_ranks

    draw = np.random.default_rng(4)
    data = pd.DataFrame({"a": draw.integers(0, 5, 300).astype(float), "b": draw.normal(size=300), "c": np.where(np.arange(300) < 200, 0.0, np.nan)})
    got = [tuple(r["ranks"]) for r in average_ranks(spark.createDataFrame(data), ["a", "b", "c"], buckets=7).collect()]
    want = [tuple(None if pd.isna(x) else float(x) for x in r) for r in data.rank().itertuples(index=False)]
    assert sorted(got, key=str) == sorted(want, key=str)
