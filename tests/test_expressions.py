import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardtable.functions import expressions as X


def one(spark, values, schema, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_first_number(spark):
    texts = ["38.5 C", "-3", "38,5", "nan", None, "a12b7.5", "12.", ".5"]
    assert one(spark, texts, "string", X.first_number(F.col("x"))) == [38.5, 3.0, 38.0, None, None, 12.0, 12.0, 5.0]


def test_normalise_code(spark):
    texts = ["2.0", "2", None, "abc", "123456789012345678", "1.5"]
    assert one(spark, texts, "string", X.normalise_code(F.col("x"))) == [
        "2", "2", "0", None, "123456789012345678", None,
    ]


def test_temperature_class(spark):
    assert one(spark, [35.9, 36.0, 37.9, 38.0, None], "double", X.temperature_class(F.col("x"))) == [1, 0, 0, 2, None]


def test_threshold_flag_falls_back_to_the_recorded_flag(spark):
    df = spark.createDataFrame([(100.0, 0), (101.0, 1), (None, 7), (None, None)], "m double, f int")
    got = [r[0] for r in df.select(X.threshold_flag(F.col("m"), F.col("f"), "<=", 100)).collect()]
    assert got == [1, 0, 7, None]


def test_missing_lactate_counts_as_raised(spark):
    texts = ["<= 2 millimole per liter", "> 2 millimole per liter", None]
    assert one(spark, texts, "string", X.differs_flag(F.col("x"), texts[0])) == [0, 1, 1]


def test_duration_class(spark):
    assert one(spark, [0.0, 1.0, 7.0, 8.0, -1.0], "double", X.duration_class(F.col("x"))) == [0, 1, 1, 2, 1]


def test_text_flags(spark):
    texts = ["True", "False", None, "0", "1.0"]
    assert one(spark, texts, "string", X.text_flag(F.col("x"))) == [1, 0, 0, 0, 0]
    assert one(spark, texts, "string", X.false_text_to_int(F.col("x"))) == [1, 0, None, 0, 1]


def test_positive_names_need_exactly_one(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (0, 0, 0)], "`b.c` int, a int, z int")
    got = [r[0] for r in df.select(X.positive_names(["b.c", "z", "a"])).collect()]
    assert got == [["b.c", "z"], ["NEGATIVE"], ["NEGATIVE"]]


def test_bad_dates_and_corrections(spark):
    texts = ["2023-05-01", "323-05-01", "2023-05-01 10:00", None, "x"]
    assert one(spark, texts, "string", X.is_bad_date(F.col("x"))) == [False, True, False, True, True]
    fixed = X.parse_date(X.fix_values(F.col("x"), {"323-05-01": "2023-05-01"}))
    assert one(spark, texts[:2], "string", fixed) == [dt.date(2023, 5, 1)] * 2


def test_days(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2, 0), dt.datetime(2024, 1, 2, 12))], "a timestamp, b timestamp"
    )
    row = df.select(X.days_between(F.col("a"), F.col("b")), X.floor_days_between(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (0, -1)


def test_break_label(spark):
    assert one(spark, ["abcdefghij", "abcdefghijk", ""], "string", X.break_label(F.col("x"))) == [
        "abcdefghij", "abcdefghij\nk", "",
    ]


def test_round_half_even(spark):
    assert one(spark, [0.25, 0.35, 2.5, -0.25], "double", X.round_half_even(F.col("x"))) == [0.2, 0.4, 2.5, -0.2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,- a", max_size=12), min_size=1, max_size=20))
def test_first_number_matches_python(spark, texts):
    import re

    want = []
    for t in texts:
        found = re.findall(r"\d+\.\d+|\d+", t)
        want.append(float(found[0]) if found else None)
    assert one(spark, texts, "string", X.first_number(F.col("x"))) == want
