import random

import pytest
from pyspark.sql import functions as F

from vitalcov.operators import checks
from vitalcov.operators import tabulate as T

RECORDS = "year int, geo_code string, sex string, age double"


@pytest.fixture(scope="module")
def records():
    rnd = random.Random(7)
    return [
        (
            rnd.choice([2000, 2010]),
            rnd.choice(["11", "12", "35", None]),
            rnd.choice(["Masculino", "Feminino", None]),
            rnd.choice([None, -1.0, 0.0, 4.999, 33.3, 84.9, 85.0, 124.9, 125.0]),
        )
        for _ in range(3000)
    ]


def cells(df, value="n"):
    return {tuple(r[c] for c in T.CELL): r[value] for r in df.collect()}


def brute_counts(records):
    out = {}
    for year, geo, sex, age in records:
        band = None if age is None or not 0 <= age < 125 else min(int(age // 5) * 5, 85)
        for place in (geo, "BR"):
            key = (year, place, sex, band)
            out[key] = out.get(key, 0) + 1
    return out


def test_tabulation_equals_brute_force(spark, records):
    got = cells(T.tabulate_events(spark.createDataFrame(records, RECORDS)))
    assert got == brute_counts(records)


def test_total_includes_unknown_place(spark, records):
    out = T.tabulate_events(spark.createDataFrame(records, RECORDS))
    total = out.where("geo_code = 'BR'").agg(F.sum("n")).first()[0]
    places = out.where("geo_code IS NULL OR geo_code <> 'BR'").agg(F.sum("n")).first()[0]
    assert total == places == len(records)


def test_tabulation_ignores_order_and_partitions(spark, records):
    shuffled = records[:]
    random.Random(1).shuffle(shuffled)
    one = cells(T.tabulate_events(spark.createDataFrame(records, RECORDS).coalesce(1)))
    many = cells(T.tabulate_events(spark.createDataFrame(shuffled, RECORDS).repartition(13)))
    assert one == many


def test_codebook_table_equals_mapping(spark):
    raw = spark.createDataFrame([("3550308", c, "20", 2000) for c in ("1", "2", "9", None)], "mun_code string, sex_code string, mother_age string, year int")
    table = spark.sql("SELECT * FROM VALUES ('1', 'Masculino'), ('2', 'Feminino') AS t(sex_code, sex)")
    by_map = T.slim_births(raw, {"1": "Masculino", "2": "Feminino"}).collect()
    by_table = T.slim_births(raw, table).collect()
    assert sorted(map(str, by_map)) == sorted(map(str, by_table))
    assert sorted(r["sex"] or "" for r in by_map) == ["", "", "Feminino", "Masculino"]


def test_population_drops_source_totals_and_reads_labels(spark):
    rows = [
        (2000, "11", "Male", "From 5 to 9 years", 10),
        (2000, "11", "Female", "From 45 to 49 years", 20),
        (2000, "12", "Male", "From 5 to 9 years", 5),
        (2000, "11", "Male", "Total", 999),
        (1991, "11", "Male", "From 5 to 9 years", 7),
    ]
    raw = spark.createDataFrame(rows, "year int, geo_code string, sex_label string, age_label string, pop long")
    got = cells(T.population_counts(raw, [2000, 2010]), "pop")
    assert got == {
        (2000, "11", "Masculino", 5): 10,
        (2000, "11", "Feminino", 45): 20,
        (2000, "12", "Masculino", 5): 5,
        (2000, "BR", "Masculino", 5): 15,
        (2000, "BR", "Feminino", 45): 20,
    }


def test_numeric_place_codes_become_text(spark):
    raw = spark.createDataFrame([(2000, 11, "Male", "From 0 to 4 years", 1)], "year int, geo_code int, sex_label string, age_label string, pop int")
    assert ("geo_code", "string") in T.population_counts(raw).dtypes


def test_rebands_keeps_unknown_age(spark):
    rows = [(2000, "11", "Feminino", b, 1.0) for b in (75, 80, 85, None)]
    df = spark.createDataFrame(rows, "year int, geo_code string, sex string, age_band int, n double")
    assert cells(T.rebands(df)) == {
        (2000, "11", "Feminino", 75): 1.0,
        (2000, "11", "Feminino", 80): 2.0,
        (2000, "11", "Feminino", None): 1.0,
    }


def test_mean_over_years(spark):
    rows = [(y, "11", "Feminino", 0, n) for y, n in ((2000, 10.0), (2010, 13.0))]
    df = spark.createDataFrame(rows, "year int, geo_code string, sex string, age_band int, n double")
    assert T.mean_over_years(df, [2000, 2010]).first()["n"] == 11.5
    # a year without a record counts 0, whether it is absent or was left out; other years do not count
    assert T.mean_over_years(df, [2000, 2005]).first()["n"] == 5.0


def test_densify_fills_and_keeps(spark):
    rows = [(2000, "11", "f", 0, 3.0), (2000, "11", "f", 10, 4.0), (2000, "12", "f", 99, 1.0), (2000, "13", "f", None, 2.0)]
    df = spark.createDataFrame(rows, "year int, geo_code string, sex string, age_band int, n double")
    got = cells(T.densify(df, {"n": F.col("n")}, [0, 5, 10]))
    expected = {(2000, g, "f", b): 0.0 for g in ("11", "12", "13") for b in (0, 5, 10)}
    expected |= {(2000, "13", "f", None): 2.0}
    expected |= {(2000, "11", "f", 0): 3.0, (2000, "11", "f", 10): 4.0, (2000, "12", "f", 99): 1.0}
    assert got == expected


def test_densify_keeps_a_missing_value_missing(spark):
    rows = [(2000, "11", "f", 0, None), (2000, "11", "f", 0, 4.0), (2000, "11", "f", 5, 4.0)]
    df = spark.createDataFrame(rows, "year int, geo_code string, sex string, age_band int, n double")
    got = cells(T.densify(df, {"n": F.col("n")}, [0, 5, 10]))
    assert got == {(2000, "11", "f", 0): None, (2000, "11", "f", 5): 4.0, (2000, "11", "f", 10): 0.0}


def test_totals_of_the_source_do_not_count_twice(spark):
    df = spark.createDataFrame([(2000, "11", "f", 0, 5), (2000, "BR", "f", 0, 5)], "year int, geo_code string, sex string, age_band int, n long")
    assert cells(T.with_total(df, "n")) == {(2000, "11", "f", 0): 5, (2000, "BR", "f", 0): 5}
    rows = [(2000, g, s, "From 5 to 9 years", n) for g in ("11", "BR") for s, n in (("Male", 4), ("Female", 6), ("Total", 10))]
    raw = spark.createDataFrame(rows, "year int, geo_code string, sex_label string, age_label string, pop long")
    got = cells(T.population_counts(raw), "pop")
    assert got == {(2000, g, s, 5): n for g in ("11", "BR") for s, n in (("Masculino", 4), ("Feminino", 6))}


def test_codebook_with_a_repeated_code_is_refused(spark):
    raw = spark.createDataFrame([("3550308", "1", "20", 2000)], "mun_code string, sex_code string, mother_age string, year int")
    twice = spark.createDataFrame([("1", "a"), ("1", "b")], "sex_code string, sex string")
    with pytest.raises(ValueError, match="twice"):
        T.slim_births(raw, twice)
    with pytest.raises(ValueError, match="more than"):
        T.code_lookup(spark.range(1001).selectExpr("CAST(id AS STRING) AS sex_code", "'x' AS sex"), "sex_code", "sex")


def test_undated_deaths_and_odd_codes_stay_in_the_total(spark):
    rows = [("1100015", 2000, "2000-03-01"), ("110001", 2000, None), ("35503", None, "2000-05-05"), (" 355030 ", None, None)]
    raw = spark.createDataFrame(rows, "mun_code string, year int, d string").selectExpr(
        "mun_code", "'1' AS sex_code", "'5' AS age_years", "CAST(d AS DATE) AS death_date", "year"
    )
    got = cells(T.tabulate_events(T.slim_deaths(raw, {"1": "m"})))
    assert got == {
        (2000, "11", "m", 5): 2, (2000, None, "m", 5): 1, (None, "35", "m", 5): 1, (2000, "BR", "m", 5): 3, (None, "BR", "m", 5): 1,
    }


def test_unmatched_keys(spark):
    ddl = "year int, geo_code string"
    left = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], ddl)
    right = spark.createDataFrame([(1, "b"), (3, "c"), (2, None)], ddl)
    got = sorted(tuple(r) for r in checks.unmatched_keys(left, right, ["year", "geo_code"]).fillna("-").collect())
    assert got == [(1, "a", "left"), (2, "-", "left"), (2, "-", "right"), (3, "c", "right")]


def test_missing_bands(spark):
    rows = [(2000, "11", "f", b) for b in (0, 10)] + [(2000, "12", "f", b) for b in (0, 5, 10)]
    df = spark.createDataFrame(rows, "year int, geo_code string, sex string, age_band int")
    got = [tuple(r) for r in checks.missing_bands(df, [0, 5, 10]).collect()]
    assert got == [(2000, "11", "f", 5)]
