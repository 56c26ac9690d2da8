import re

import pytest
from pyspark.sql import functions as F
from synthetic import DDL, stable_rows

from vitalcov.functions.windows import moving_average, strict_total
from vitalcov.operators import coverage as C
from vitalcov.operators import ddm as D
from vitalcov.operators.checks import value_range
from vitalcov.plans.estimate import age_rows, estimate_birth_coverage, smooth_counts
from vitalcov.sources import dims
from vitalcov.sources import tables as IO

CELL = "year int, geo_code string, sex string, age_band int"


@pytest.fixture(scope="module")
def tables(spark):
    """Deaths, births and population of three places; place 13 has no births in 2010."""
    ages = [r for g, share in (("11", 0.9), ("12", 0.7), ("13", 0.8)) for r in stable_rows(g, "Feminino", share, 1.0)]
    pop = [(y, r[0], r[1], r[2], int(r[i])) for r in ages for y, i in ((2000, 5), (2010, 6))]
    deaths = [(y, r[0], r[1], r[2], r[7]) for r in ages for y in (2000, 2010)]
    births = [
        (y, g, "Feminino", m, n)
        for g in ("11", "12", "13")
        for y, n in ((2000, 400.0), (2010, 500.0))
        for m in (20, 25)
        if (g, y) != ("13", 2010)
    ]
    return (
        spark.createDataFrame(deaths, f"{CELL}, n double"),
        spark.createDataFrame(births, f"{CELL}, n double"),
        spark.createDataFrame(pop, f"{CELL}, pop long"),
        dims.e_open_table(spark, {"Feminino": ages[0][8]}),
    )


@pytest.fixture(scope="module")
def rows(tables):
    deaths, _, pop, e_open = tables
    return age_rows(deaths, pop, e_open, 2000, 2010).cache()


@pytest.fixture(scope="module")
def estimates(tables):
    return estimate_birth_coverage(*tables, (2000, 2010)).cache()


def test_ratio_of_years_is_inverse_ratio_of_births(estimates):
    ratios = {r["geo_code"]: r for r in C.coverage_ratio(estimates, 2000, 2010).collect()}
    for geo in ("11", "12"):
        assert ratios[geo]["ratio"] == pytest.approx(800 / 1000)
        assert (ratios[geo]["ratio_class"], ratios[geo]["is_missing"]) == ("2010 < 2000", False)
    assert ratios["13"]["ratio"] is None
    assert (ratios["13"]["ratio_class"], ratios["13"]["is_missing"]) == ("2010 = 2000", True)


def test_place_without_births_keeps_its_row(estimates):
    row = estimates.where("geo_code = '13' AND year = 2010").first()
    assert row["cbr"] is None and row["coverage_b"] is None and row["completeness"] is None
    assert row["birth_rate_implied"] is not None
    assert estimates.count() == 6


def test_completeness_is_the_inverse(estimates):
    for r in estimates.where("cbr IS NOT NULL").collect():
        assert r["coverage_b"] * r["completeness"] == pytest.approx(1.0)
        assert r["coverage_b"] == pytest.approx(r["birth_rate_implied"] / r["cbr"])


def test_deaths_are_divided_by_the_chosen_coverage(rows):
    for r in rows.collect():
        assert r["deaths_adj"] == pytest.approx(r["deaths"] / r["coverage"])


def test_joined_coverage_equals_the_column_already_there(rows):
    key = ["geo_code", "sex", "age_band"]
    joined = C.adjust_deaths(rows.drop("coverage", "deaths_adj"), D.death_coverage(rows))
    got = {tuple(r[k] for k in key): r["deaths_adj"] for r in joined.collect()}
    want = {tuple(r[k] for k in key): r["deaths_adj"] for r in rows.collect()}
    assert got == pytest.approx(want)


def test_totals_equal_the_youngest_row_of_the_profile(rows):
    cols = ["deaths_cum", "pop_cum", "cdr_adj", "rx", "birth_rate_implied"]
    profile = C.implied_birth_profile(rows).where("age_band = 0")
    young = {r["geo_code"]: [r[c] for c in cols] for r in profile.collect()}
    total = {r["geo_code"]: [r[c] for c in cols] for r in C.implied_birth_rate(rows).collect()}
    assert young.keys() == total.keys()
    assert all(young[g] == pytest.approx(total[g]) for g in total)


def test_implied_rate_matches_the_model(rows):
    """A stable population grows by births minus deaths, so its birth rate is death rate plus growth."""
    got = {r["geo_code"]: r for r in C.implied_birth_rate(rows).collect()}
    for r in got.values():
        assert r["rx"] == pytest.approx(0.02, rel=1e-3)
        assert r["birth_rate_implied"] > r["cdr_adj"] > 0


def test_place_without_coverage_is_missing_not_partial(rows):
    holed = C.adjusted_deaths(rows.withColumn("coverage", F.when(F.col("geo_code") != "11", F.col("coverage"))))
    got = {r["geo_code"]: r for r in C.implied_birth_rate(holed).collect()}
    assert got["11"]["deaths_cum"] is None and got["11"]["birth_rate_implied"] is None
    assert got["12"]["deaths_cum"] is not None
    one_age = rows.withColumn("deaths_adj", F.when(F.col("age_band") != 40, F.col("deaths_adj")))
    assert [r["deaths_cum"] for r in C.implied_birth_rate(one_age).collect()] == [None] * 3
    profile = C.implied_birth_profile(one_age).where("geo_code = '11'").collect()
    assert all((r["deaths_cum"] is None) == (r["age_band"] <= 40) for r in profile)


def test_strict_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", 1.0)], "k string, v double")
    assert dict(df.groupBy("k").agg(strict_total(F.col("v")).alias("t")).collect()) == {"a": 3.0, "b": None}


def test_ratio_of_exactly_one(spark):
    est = spark.createDataFrame(
        [("11", "f", 2000, 0.5), ("11", "f", 2010, 0.5), ("12", "f", 2000, 0.0), ("12", "f", 2010, 0.5)],
        "geo_code string, sex string, year int, coverage_b double",
    )
    got = {r["geo_code"]: (r["ratio"], r["ratio_class"]) for r in C.coverage_ratio(est, 2000, 2010).collect()}
    assert got == {"11": (1.0, "2010 = 2000"), "12": (None, "2010 = 2000")}


def test_region_table_leaves_out_the_country(spark):
    ratios = spark.createDataFrame(
        [("11", "f", 0.5, 0.6, 1.2, "2010 > 2000"), ("77", "f", 1.0, 1.0, 1.0, "2010 = 2000"), ("BR", "f", 1.0, 1.0, 1.0, "x")],
        "geo_code string, sex string, coverage_y1 double, coverage_y2 double, ratio double, ratio_class string",
    )
    regions = spark.createDataFrame([("11", "Norte", bytearray(b"\x01\x02"))], "geo_code string, region string, geometry binary")
    got = {r["geo_code"]: r for r in C.attach_regions(ratios, dims.geo_dim(spark), regions).collect()}
    assert got.keys() == {"11", "77"}
    assert (got["11"]["geo_name"], got["11"]["region"], bytes(got["11"]["geometry"])) == ("Rondônia", "Norte", b"\x01\x02")
    assert got["77"]["geo_name"] is None and got["77"]["geometry"] is None


def test_geo_dim_order(spark):
    dim = dims.geo_dim(spark).orderBy("geo_ord").collect()
    assert len(dim) == 28 and dim[0]["geo_code"] == "11"
    assert (dim[-1]["geo_code"], dim[-1]["geo_name"]) == ("BR", "Brasil")


def test_moving_average_counts_calendar_years(spark):
    rows = [(y, "11", "f", 0, n) for y, n in ((2000, 3.0), (2001, 6.0), (2002, 9.0), (2005, 1.0))]
    out = moving_average(spark.createDataFrame(rows, f"{CELL}, n double"))
    got = {r["year"]: (r["n_smooth"], r["n_years"]) for r in out.collect()}
    assert got == {2000: (4.5, 2), 2001: (6.0, 3), 2002: (7.5, 2), 2005: (1.0, 1)}
    with pytest.raises(ValueError):
        moving_average(out, span=2)


def test_value_range(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-2.0,)], "v double")
    assert tuple(value_range(df, "v").first()) == (-2.0, 1.0)


def test_levels_in_place_of_e_open_values(spark, tables, rows):
    deaths, _, pop, e_open = tables
    value = e_open.first()["e_open"]
    flat = dims.e_open_levels_table(spark, {"Feminino": [(0.1, value), (5.0, value)]})
    cols = ["geo_code", "ggb", "seg", "ggbseg", "coverage"]
    by_levels = D.death_coverage(age_rows(deaths, pop, flat, 2000, 2010)).select(cols)
    by_value = D.death_coverage(rows).select(cols)
    got, want = ({r[0]: tuple(r)[1:] for r in df.collect()} for df in (by_levels, by_value))
    assert all(got[g] == pytest.approx(want[g]) for g in want)


def test_smoothing_counts_empty_bands_as_zero(spark):
    cells = [(2000, "11", "f", 0, 3.0), (2001, "11", "f", 0, 6.0), (2001, "11", "f", 5, 4.0), (2002, "11", "f", 0, 9.0)]
    years = [2000, 2001, 2002]
    out = smooth_counts(spark.createDataFrame(cells, f"{CELL}, n double"), years, bands=[0, 5])
    got = {(r["year"], r["age_band"]): (r["n"], r["n_years"]) for r in out.collect()}
    assert got == {
        (2000, 0): (4.5, 2), (2001, 0): (6.0, 3), (2002, 0): (7.5, 2),
        (2000, 5): (2.0, 2), (2001, 5): (pytest.approx(4 / 3), 3), (2002, 5): (2.0, 2),
    }


def test_smoothing_counts_a_year_without_any_event_as_zero(spark):
    cells = [(2000, "11", "f", 0, 3.0), (2002, "11", "f", 0, 9.0), (2001, "12", "f", 0, 6.0)]
    out = smooth_counts(spark.createDataFrame(cells, f"{CELL}, n double"), [2000, 2001, 2002], [2001], bands=[0])
    assert {(r["geo_code"], r["year"]): (r["n"], r["n_years"]) for r in out.collect()} == {
        ("11", 2001): (4.0, 3),
        ("12", 2001): (2.0, 3),
    }


def test_smoothing_reads_the_neighbour_years_only(spark, tmp_path):
    path = str(tmp_path / "counts")
    cells = [(y, "11", "f", 0, float(y)) for y in range(1995, 2015)]
    IO.write_table(spark.createDataFrame(cells, f"{CELL}, n double"), path, "spread_counts")
    saved = IO.read_table(spark, path, "spread_counts")
    out = smooth_counts(saved, list(range(1995, 2015)), [2000, 2010], bands=[0])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert {m for m in re.findall(r"year#\d+ IN \(([\d,]+)\)", text.split("PartitionFilters")[1])} == {"1999,2000,2001,2009,2010,2011"}
    assert {r["year"]: r["n"] for r in out.collect()} == {2000: 2000.0, 2010: 2010.0}


def test_births_total_of_given_years(tables):
    births = tables[1]
    assert {r["births"] for r in C.births_total(births, [2000]).collect()} == {800.0}
    assert C.births_total(births).count() == 5
