import datetime

import pytest
from pyspark.sql import functions as F

from vitalcov.functions import scalars as S


def values(spark, rows, ddl, col):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(col).collect()]


def test_age_band_edges(spark):
    ages = [-1.0, 0.0, 4.999, 5.0, 84.9, 85.0, 124.9, 125.0, float("nan"), float("inf"), None]
    got = values(spark, [(a,) for a in ages], "a double", S.top_code(S.age_band(F.col("a")), 85))
    assert got == [None, 0, 0, 5, 80, 85, 85, None, None, None, None]


def test_lower_open_band(spark):
    got = values(spark, [(75,), (80,), (85,), (None,)], "b int", S.top_code(F.col("b"), 80))
    assert got == [75, 80, 80, None]


def test_code_prefix_and_state(spark):
    codes = [("3550308",), ("355030",), ("1234",), ("",), (None,)]
    assert values(spark, codes, "c string", S.state_code(F.col("c"))) == ["35", "35", None, None, None]
    assert values(spark, codes, "c string", S.code_prefix(F.col("c"), -6)) == ["35", "3", "", "", None]
    assert values(spark, codes[:2], "c string", S.code_prefix(F.col("c"), -1)) == ["3550308", "355030"]


def test_band_from_label_ignores_text_order(spark):
    labels = [("From 5 to 9 years",), ("From 45 to 49 years",), ("From 80 years or more",), ("Total",), ("[85,90)",)]
    assert values(spark, labels, "l string", S.band_from_label(F.col("l"))) == [5, 45, 80, None, 85]


def test_number_never_raises(spark):
    texts = [("12",), (" 7 ",), ("ign",), ("",), (None,), ("3.5",)]
    assert values(spark, texts, "t string", S.number(F.col("t"))) == [12.0, 7.0, None, None, None, 3.5]


def test_recode_and_lookup(spark):
    sexes = [("Male",), ("Female",), (None,)]
    assert values(spark, sexes, "s string", S.recode(F.col("s"), {"Male": "Masculino"}, "Feminino")) == [
        "Masculino",
        "Feminino",
        "Feminino",
    ]
    codes = [("1",), ("2",), ("9",), (None,)]
    book = {"1": "Masculino", "2": "Feminino"}
    assert values(spark, codes, "s string", S.lookup(F.col("s"), book)) == ["Masculino", "Feminino", None, None]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (0.9, "2010 < 2000"),
        (1.1, "2010 > 2000"),
        (1.0, "2010 = 2000"),
        (None, "2010 = 2000"),
        (float("nan"), "2010 = 2000"),
    ],
)
def test_ratio_class(spark, value, expected):
    assert values(spark, [(value,)], "r double", S.ratio_class(F.col("r"), 2000, 2010)) == [expected]


def test_divisions_and_logs_give_null(spark):
    rows = [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (2.0, 1.0)]
    assert values(spark, rows, "a double, b double", S.ratio(F.col("a"), F.col("b"))) == [None, 0.0, None, 2.0]
    growth = values(spark, rows, "a double, b double", S.annual_log_growth(F.col("a"), F.col("b"), F.lit(1)))
    assert growth[:3] == [None, None, None] and growth[3] == pytest.approx(0.693147, abs=1e-6)


def test_products_do_not_overflow(spark):
    big = [(2_000_000_000, 2_000_000_000)]
    assert values(spark, big, "a int, b int", S.geometric_mean(F.col("a"), F.col("b"))) == [2e9]


def test_in_years_merges_neighbours(spark):
    days = [datetime.date(1999, 12, 31), datetime.date(2000, 1, 1), datetime.date(2001, 12, 31), datetime.date(2002, 1, 1)]
    test = S.in_years(F.col("d"), [2001, 2000])
    assert values(spark, [(d,) for d in days], "d date", test) == [False, True, True, False]
    assert str(test).count(">=") == 1
    assert values(spark, [(days[0],)], "d date", S.in_years(F.col("d"), [])) == [False]
