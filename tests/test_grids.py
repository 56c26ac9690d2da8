"""Breaks, grids of other widths, which count is rescaled, and a fit criterion of the caller's."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from synthetic import BANDS, DDL, stable_population, stable_rows
from test_ddm import brute_points, by_geo, groups

from vitalcov.functions import scalars as S
from vitalcov.operators import ddm as D
from vitalcov.operators import tabulate as T
from vitalcov.operators.cumulate import cohort_mid_population
from vitalcov.plans import estimate as E

CHILDREN = (0, 1, *range(5, 85, 5))
TENS = tuple(range(0, 90, 10))
MIXED = (0, 1, 5, 10, 15, 20, 25, 30, 35, 45, 55, 60, 65, 70, 75, 80)


# breaks -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("breaks", [(0,), (0, 1, 5), CHILDREN, (3, 4, 90), tuple(range(0, 124, 1))])
def test_bands_between_breaks(spark, breaks):
    ages = [None, float("nan"), float("inf"), -1.0, -0.0, 0.0, 0.99, 1.0, 4.999, 5.0, 79.9, 80.0, 84.0, 124.9, 125.0, 1e9, *map(float, breaks)]
    df = spark.createDataFrame([(a,) for a in ages], "age double").select("age", S.band_of(F.col("age"), breaks).alias("b"))
    for age, band in df.withColumn("w", S.band_width(F.col("b"), breaks)).select("age", "b").collect():
        inside = age is not None and breaks[0] <= age < 125
        assert band == (max(b for b in breaks if b <= age) if inside else None)
    widths = dict(df.select("b", S.band_width(F.col("b"), breaks)).distinct().collect())
    for b, w in widths.items():
        assert w == (None if b is None or b == breaks[-1] else breaks[breaks.index(b) + 1] - b)


def test_breaks_must_rise_and_end_below_the_limit():
    for breaks in ((), (0, 0), (5, 1)):
        with pytest.raises(ValueError, match="rise"):
            S.check_breaks(breaks)
    with pytest.raises(ValueError, match="begin below 125"):
        S.band_of(F.lit(1), (0, 125))


def test_five_year_breaks_are_the_fixed_bands(spark):
    ages = spark.createDataFrame([(a / 2,) for a in range(-5, 270)], "age double")
    fixed = T.with_age_band(ages.withColumn("a", F.col("age"))).withColumnRenamed("a", "age")
    free = ages.withColumn("b", S.band_of(F.col("age"), range(0, 90, 5)))
    assert sorted(map(tuple, fixed.select("age", "age_band").collect())) == sorted(map(tuple, free.collect()))


# grids ------------------------------------------------------------------------------------------


def population(spark, bands, *places, **kwargs):
    rows = [r for place in places for r in stable_population(bands, *place, **kwargs)]
    return spark.createDataFrame(rows, DDL)


def covered(rows, bands, search=D.FitSearch(), **kwargs):
    return D.with_death_coverage(D.method_points(rows, bands=bands), search, bands=bands, **kwargs)


@pytest.mark.parametrize("bands", [CHILDREN, TENS, MIXED, (0, 1, 2, 3, 4, *range(5, 85, 5)), (0, 5, 15, 30, 40, 45, 50, 60, 70, 75, 80)])
@pytest.mark.parametrize(("share", "scale"), [(0.8, 1.0), (0.6, 1.05)])
def test_every_grid_recovers_known_coverage(spark, bands, share, scale):
    rows = population(spark, bands, ("11", "f", share, scale))
    inside = [b for b in bands if 15 <= b <= 75]
    got = D.death_coverage(covered(rows, bands, D.FitSearch(min_ages=len(inside) - 1))).first()
    assert got["ggb"] == pytest.approx(share / math.sqrt(scale), rel=0.05)
    assert got["ggbseg"] == pytest.approx(share, rel=0.05)
    if scale == 1.0:
        assert got["seg"] == pytest.approx(share, rel=0.05)


def test_five_and_ten_year_grids_agree(spark):
    search = {D.BANDS: D.FitSearch(), TENS: D.FitSearch(min_ages=4)}
    places = [("11", "f", 0.7, 1.0), ("12", "f", 0.9, 0.95)]
    five, ten = ({r["geo_code"]: r for r in D.death_coverage(covered(population(spark, b, *places), b, s)).collect()} for b, s in search.items())
    for geo in five:
        for method in ("ggb", "seg", "ggbseg", "mean_3"):
            assert ten[geo][method] == pytest.approx(five[geo][method], rel=0.05)


def test_arrivals_beside_bands_of_different_widths(spark):
    """At age 1 the density falls steeply: the weighted mean is near it, the plain one is not."""
    growth, years = 0.02, 10
    for bands in (CHILDREN, MIXED):
        rows = D.method_points(population(spark, bands, ("11", "f", 1.0, 1.0)), bands=bands)
        got = {r["age_band"]: r["arrivals"] for r in rows.collect()}
        exact = {r[2]: r[3] for r in stable_population(bands, "11", "f", 1.0, 1.0, density=True)}
        for age in bands[1:-1]:
            assert got[age] == pytest.approx(exact[age] * math.exp(growth * years / 2), rel=0.02), age


def test_uneven_grid_of_equal_widths_is_the_plain_one(spark):
    """The same rows: bands of five years, told as such, and as part of a grid with one wider band that has no cell."""
    rows = spark.createDataFrame(stable_rows("11", "f", 0.8, 0.97), DDL)
    plain = {r["age_band"]: r for r in D.method_points(rows).collect()}
    assert {r["w"] for r in plain.values()} == {5.0}
    assert plain[20]["arrivals"] == pytest.approx(math.sqrt(plain[15]["pop1"] * plain[20]["pop2"]) / 5, rel=1e-15)
    assert plain[20]["g_below"] == pytest.approx(5 * sum(plain[x]["r"] for x in (0, 5, 10, 15)), rel=1e-14)
    assert plain[20]["w_below"] == 20.0


def recursion(ages, bands, delta=1.0):
    """N*(x)/N(x) on a grid, by the backward recursion."""
    nxt, prev = dict(zip(bands, bands[1:])), dict(zip(bands[1:], bands))
    w = {x: (nxt[x] if x in nxt else 2 * x - prev[x]) - x for x in bands}
    rate = {x: math.log(ages[x][6] / (ages[x][5] / delta)) / 10 for x in bands}
    top = bands[-1]
    built = {top: ages[top][7] * (math.exp(rate[top] * ages[top][8]) - (rate[top] * ages[top][8]) ** 2 / 6)}
    for x in reversed(bands[:-1]):
        built[x] = built[nxt[x]] * math.exp(w[x] * rate[x]) + ages[x][7] * math.exp(w[x] * rate[x] / 2)
    out = {}
    for x in bands[1:]:
        b = prev[x]
        low, high = ages[b][5] / delta / w[b], ages[x][6] / w[x]
        weight = w[x] / (w[x] + w[b])
        out[x] = built[x] / (low**weight * high ** (1 - weight) * math.exp((weight - 0.5) * 10 * (rate[x] + rate[b]) / 2))
    return out


@pytest.fixture(scope="module")
def noisy():
    rnd = random.Random(5)
    out = []
    for g in range(4):
        for geo, sex, x, y1, y2, p1, p2, d, e in stable_population(MIXED, str(g), "f", 0.85, 0.97):
            out.append((geo, sex, x, y1, y2, *(v * rnd.uniform(0.9, 1.1) for v in (p1, p2, d)), e))
    return out


@pytest.mark.parametrize("rescale", ["first", "second", "both"])
def test_extinct_generations_of_uneven_bands_equal_the_recursion(spark, noisy, rescale):
    rows = D.method_points(spark.createDataFrame(noisy, DDL), bands=MIXED).withColumn("delta", F.lit(0.9))
    got = by_geo(D.ggb_seg(D.seg(rows, (5, 75)), (5, 75), rescale=rescale).where("age_band = 0"), "seg", "ggbseg")
    for geo, ages in groups(noisy).items():
        plain = [v for x, v in recursion(ages, MIXED).items() if 5 <= x <= 75]
        one, two = {"first": (0.9, 1.0), "second": (1.0, 0.9), "both": (math.sqrt(0.9), math.sqrt(0.9))}[rescale]
        moved = {x: (*r[:5], r[5] / one, r[6] * two, *r[7:]) for x, r in ages.items()}
        scaled = [v for x, v in recursion(moved, MIXED).items() if 5 <= x <= 75]
        assert got[geo] == pytest.approx((np.mean(plain), np.mean(scaled)), rel=1e-9)


@pytest.mark.parametrize("rescale", ["first", "second", "both"])
def test_counts_that_agree_need_no_rescaling(spark, noisy, rescale):
    rows = D.method_points(spark.createDataFrame(noisy, DDL), bands=MIXED).withColumn("delta", F.lit(1.0))
    for seg, ggbseg in by_geo(D.ggb_seg(D.seg(rows), (15, 75), rescale=rescale).where("age_band = 0"), "seg", "ggbseg").values():
        assert seg == pytest.approx(ggbseg, rel=1e-12)


@pytest.mark.parametrize(("rescale", "relative_to"), [("first", 1.0), ("second", 1 / 1.05), ("both", 1 / math.sqrt(1.05))])
def test_coverage_is_relative_to_the_count_left_as_it_is(spark, rescale, relative_to):
    """The first count is 1.05 times too large: by which count coverage is measured."""
    rows = spark.createDataFrame(stable_rows("11", "f", 0.8, 1.05), DDL)
    got = D.death_coverage(covered(rows, D.BANDS, rescale=rescale)).first()
    assert got["ggbseg"] == pytest.approx(0.8 * relative_to, rel=0.02)


def test_what_is_not_possible_is_refused():
    with pytest.raises(ValueError, match="6 ages of the grid lie between 15 and 75"):
        D.FitSearch().reaches(TENS)
    for bands in ((5, 10, 15), (0, 5), (0, 5, 5, 10)):
        with pytest.raises(ValueError):
            D.Settings(bands=bands)
    with pytest.raises(ValueError, match="rescale"):
        D.Settings(rescale="third")
    assert D.FitSearch().reaches(D.BANDS) == [35, 40, 45, 50, 55, 60]
    assert D.common_width(MIXED) == 5 and D.common_width(TENS) == 10


# cohorts ----------------------------------------------------------------------------------------


def test_cohorts_on_an_even_grid_are_the_shifted_bands(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([("11", "f", x, 2000, 2010, rnd.random(), rnd.random(), 0.0, 0.0) for x in BANDS], DDL)
    shifted, spanned = (by_age_mid(cohort_mid_population(rows, years=years)) for years in (None, 10))
    assert spanned == pytest.approx(shifted)


def by_age_mid(df):
    return {r["age_band"]: r["pop_mid"] for r in df.collect()}


def test_cohorts_of_children(spark):
    count = {0: (10.0, 20.0), 1: (40.0, 80.0), 5: (50.0, 100.0), 10: (55.0, 110.0), 15: (60.0, 120.0), 75: (9.0, 30.0), 80: (5.0, 7.0)}
    rows = [("11", "f", x, 2000, 2010, *count.get(x, (1.0, 1.0)), 0.0, 0.0) for x in CHILDREN]
    got = by_age_mid(cohort_mid_population(spark.createDataFrame(rows, DDL), years=10))
    assert got[0] == pytest.approx(math.sqrt(10 * 110 / 5)) and got[1] == pytest.approx(math.sqrt(40 * 110 * 4 / 5))
    assert got[5] == pytest.approx(math.sqrt(50 * 120)) and got[70] == pytest.approx(math.sqrt(1 * 7))
    assert got[75] == pytest.approx(math.sqrt(1 * 30)) and got[80] == pytest.approx(math.sqrt(1 * 7))


def test_whole_plan_on_grids_agrees(spark):
    """Counts of one population in bands of five years, with infants apart, and in the mixed grid."""
    cell = "year int, geo_code string, sex string, age_band int"
    got = {}
    for bands in (D.BANDS, CHILDREN, MIXED):
        rows = stable_population(bands, "11", "f", 0.8, 1.0)
        pop = spark.createDataFrame([(y, "11", "f", r[2], int(r[k])) for r in rows for y, k in ((2000, 5), (2010, 6))], f"{cell}, pop long")
        deaths = spark.createDataFrame([(y, "11", "f", r[2], r[7]) for r in rows for y in (2000, 2010)], f"{cell}, n double")
        births = spark.createDataFrame([(y, "11", "f", 25, 1e6) for y in (2000, 2010)], f"{cell}, n double")
        out = E.estimate_birth_coverage(deaths, births, pop, {"f": rows[-1][8]}, (2000, 2010), D.Settings(bands=bands))
        got[bands] = {r["year"]: r["coverage_b"] for r in out.collect()}
    for bands in (CHILDREN, MIXED):
        assert got[bands] == pytest.approx(got[D.BANDS], rel=0.03)


# criterion --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "own"), [("r2", D.r2_criterion), ("rms", D.rms_criterion)])
def test_the_named_criteria_as_functions(spark, noisy, name, own):
    holed = [r if (r[0], r[2]) != ("1", 35) else (*r[:5], 0.0, *r[6:]) for r in noisy] + [("9", "f", x, 2000, 2010, 0.0, 0.0, 0.0, 7.0) for x in MIXED]
    points = D.method_points(spark.createDataFrame(holed, DDL), bands=MIXED)
    cols = ("fit_lo", "fit_hi", "ggb", "delta")
    window = D.ggb(points, D.FitSearch(criterion=name), bands=MIXED)
    grouped = D.ggb(points, D.FitSearch(criterion=own), bands=MIXED)
    assert grouped.columns == window.columns and grouped.count() == len(holed)
    want, got = (by_geo(df.where("age_band = 0"), *cols) for df in (window, grouped))
    assert got["9"] == want["9"] == (None,) * 4
    for geo in want:
        if geo != "9":
            assert got[geo] == pytest.approx(want[geo], rel=1e-9)


def test_a_criterion_reaches_the_whole_estimate(spark):
    """Longest run first, which neither named criterion prefers."""
    rows = spark.createDataFrame(stable_rows("11", "f", 0.8, 1.0), DDL)
    got = D.death_coverage(covered(rows, D.BANDS, D.FitSearch(criterion=lambda ages, x, y, slope, intercept: -len(ages)))).first()
    assert (got["fit_lo"], got["fit_hi"]) == (15, 75) and got["ggbseg"] == pytest.approx(0.8, rel=0.03)


def test_runs_without_a_score_or_a_slope():
    ages, x = np.arange(0, 85, 5.0), np.linspace(1, 2, 17)
    search = D.FitSearch(criterion=lambda *a: float("nan"))
    assert D.best_run(ages, x, 2 * x, 10, search) is None
    flat = D.FitSearch(criterion=D.rms_criterion)
    assert D.best_run(ages, x, np.ones(17), 10, flat) is None
    assert D.best_run(ages, x, 2 * x + 1e3, 10, flat)[3] is None
    assert D.best_run(ages, x, 2 * x, 10, flat)[:2] == (15, 50)


def test_groups_too_large_are_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_AGES", 16)
    rows = D.method_points(spark.createDataFrame(stable_rows("11", "f", 0.8, 1.0), DDL))
    with pytest.raises(Exception, match="more than 16 ages"):
        D.ggb(rows, D.FitSearch(criterion=D.r2_criterion)).collect()


def test_points_of_the_plain_grid_are_unchanged(spark, noisy):
    ages = {r[2]: r for r in stable_rows("11", "f", 0.8, 0.95)}
    rows = D.method_points(spark.createDataFrame(list(ages.values()), DDL))
    want = brute_points(ages)
    for r in rows.where("age_band > 0").collect():
        assert (r["ggb_left"], r["ggb_right"], r["arrivals"]) == pytest.approx(want[r["age_band"]], rel=1e-12)
