import math
import random
import statistics

import pytest
from pyspark.sql import functions as F
from synthetic import BANDS, DDL, stable_rows

from vitalcov.operators import ddm as D
from vitalcov.operators.cumulate import cohort_mid_population, growth_rates
from vitalcov.sources import dims


def covering(df):
    return D.with_death_coverage(D.method_points(df))


def by_geo(df, *cols):
    return {r["geo_code"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


@pytest.fixture(scope="module")
def noisy_rows():
    """Populations with noise, so that the candidate fits differ."""
    rnd = random.Random(3)
    rows = []
    for g in range(6):
        for geo, sex, x, y1, y2, p1, p2, d, e in stable_rows(str(g), "f", 0.85, 0.97):
            rows.append((geo, sex, x, y1, y2, *(v * rnd.uniform(0.9, 1.1) for v in (p1, p2, d)), e))
    return rows


@pytest.fixture(scope="module")
def covered(spark, noisy_rows):
    return covering(spark.createDataFrame(noisy_rows, DDL)).cache()


@pytest.mark.parametrize(("share", "scale"), [(0.8, 1.0), (0.8, 0.95), (0.6, 1.05)])
def test_recovers_known_coverage(spark, share, scale):
    rows = spark.createDataFrame(stable_rows("11", "f", share, scale), DDL)
    got = D.death_coverage(covering(rows)).first()
    assert got["ggb"] == pytest.approx(share / math.sqrt(scale), rel=0.02)
    assert got["delta"] == pytest.approx(scale, rel=0.02)
    assert got["ggbseg"] == pytest.approx(share, rel=0.02)
    if scale == 1.0:
        assert got["seg"] == pytest.approx(share, rel=0.02)
    else:
        assert abs(got["seg"] / share - 1) > 0.05


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], {})[r[2]] = r
    return out


def brute_points(ages):
    points = {}
    for x in BANDS:
        older = [ages[y] for y in ages if y >= x]
        p1, p2, d = (sum(r[i] for r in older) for i in (5, 6, 7))
        exposure = math.sqrt(p1 * p2)
        if x:
            arrivals = math.sqrt(ages[x - 5][5] * ages[x][6]) / 5
            points[x] = (arrivals / exposure - math.log(p2 / p1) / 10, d / exposure, arrivals)
    return points


def brute_fit(points, criterion):
    best = None
    for lo in range(15, 80, 5):
        for hi in range(lo + 35, 80, 5):
            left = [points[x][0] for x in range(lo, hi + 1, 5)]
            right = [points[x][1] for x in range(lo, hi + 1, 5)]
            slope = statistics.stdev(left) / statistics.stdev(right)
            residuals = [a - slope * b for a, b in zip(left, right)]
            score = (
                -statistics.correlation(left, right) ** 2 if criterion == "r2" else statistics.variance(residuals)
            )
            k = statistics.mean(residuals)
            candidate = (round(score, 12), lo, hi, 1 / slope, math.exp(10 * k))
            best = candidate if best is None or candidate < best else best
    return best[1:]


@pytest.mark.parametrize("criterion", ["r2", "rms"])
def test_fit_search_equals_trying_every_run(spark, noisy_rows, criterion):
    points = D.method_points(spark.createDataFrame(noisy_rows, DDL))
    fitted = D.ggb(points, D.FitSearch(criterion=criterion)).where("age_band = 0")
    got = by_geo(fitted, "fit_lo", "fit_hi", "ggb", "delta")
    for geo, ages in groups(noisy_rows).items():
        assert got[geo] == pytest.approx(brute_fit(brute_points(ages), criterion), rel=1e-9)


def recursion(ages, first_scale=1.0):
    """N*(x)/N(x) by the backward recursion, on a first count divided by ``first_scale``."""
    rate = {x: math.log(ages[x][6] / (ages[x][5] / first_scale)) / 10 for x in ages}
    built = {80: ages[80][7] * (math.exp(rate[80] * ages[80][8]) - (rate[80] * ages[80][8]) ** 2 / 6)}
    for x in range(75, -5, -5):
        built[x] = built[x + 5] * math.exp(5 * rate[x]) + ages[x][7] * math.exp(2.5 * rate[x])
    return {x: built[x] / (math.sqrt(ages[x - 5][5] / first_scale * ages[x][6]) / 5) for x in range(5, 80, 5)}


def test_extinct_generations_equal_the_recursion(noisy_rows, covered):
    got = by_geo(D.death_coverage(covered), "seg", "ggbseg", "fit_lo", "fit_hi", "delta")
    for geo, ages in groups(noisy_rows).items():
        seg, ggbseg, lo, hi, delta = got[geo]
        assert seg == pytest.approx(statistics.mean(v for x, v in recursion(ages).items() if x >= 15), rel=1e-9)
        scaled = [v for x, v in recursion(ages, delta).items() if lo <= x <= hi]
        assert ggbseg == pytest.approx(statistics.mean(scaled), rel=1e-9)


def test_combined_method_equals_plain_one_when_counts_agree(spark, noisy_rows):
    rows = D.method_points(spark.createDataFrame(noisy_rows, DDL)).withColumn("delta", F.lit(1.0))
    both = D.ggb_seg(D.seg(rows, (15, 75)), (15, 75)).where("age_band = 0")
    for seg, ggbseg in by_geo(both, "seg", "ggbseg").values():
        assert seg == pytest.approx(ggbseg, rel=1e-12)


def test_median_over_the_fit_ages(spark, noisy_rows):
    rows = D.method_points(spark.createDataFrame(noisy_rows, DDL))
    got = by_geo(D.seg(rows, (20, 60), "median").where("age_band = 0"), "seg")
    for geo, ages in groups(noisy_rows).items():
        want = statistics.median(v for x, v in recursion(ages).items() if 20 <= x <= 60)
        assert got[geo] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("delta", [1e-60, 1e-8, 1e8])
def test_extreme_rescaling_stays_finite(spark, noisy_rows, delta):
    rows = D.method_points(spark.createDataFrame(noisy_rows, DDL)).withColumn("delta", F.lit(delta))
    got = by_geo(D.ggb_seg(rows, (15, 75)).where("age_band = 0"), "ggbseg")
    for geo, ages in groups(noisy_rows).items():
        want = statistics.mean(v for x, v in recursion(ages, delta).items() if x >= 15)
        assert got[geo] == pytest.approx(want, rel=1e-6)


def test_unknown_open_age_expectancy_gives_no_estimate(spark, noisy_rows):
    rows = D.method_points(spark.createDataFrame([(*r[:8], None) for r in noisy_rows], DDL))
    assert {r["seg"] for r in D.seg(rows).collect()} == {None}


def test_row_order_and_partitions_do_not_matter(spark, noisy_rows, covered):
    again = covering(spark.createDataFrame(noisy_rows[::-1], DDL).repartition(7))
    want = by_geo(D.death_coverage(covered), *D.METHODS, "coverage")
    got = by_geo(D.death_coverage(again), *D.METHODS, "coverage")
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def test_zero_cells_are_left_out_of_the_fit(spark, noisy_rows):
    holed = [r if (r[0], r[2]) != ("0", 40) else (*r[:5], 0.0, *r[6:]) for r in noisy_rows]
    out = covering(spark.createDataFrame(holed, DDL))
    rows = {r["geo_code"]: r for r in D.death_coverage(out).collect()}
    assert rows["0"]["ggb"] is not None and rows["0"]["fit_hi"] - rows["0"]["fit_lo"] >= 40
    assert rows["0"]["coverage"] is not None


def test_no_fit_gives_null(spark, noisy_rows):
    empty = [r if r[0] != "0" else (*r[:7], 0.0, r[8]) for r in noisy_rows]
    got = {r["geo_code"]: r for r in D.death_coverage(covering(spark.createDataFrame(empty, DDL))).collect()}
    assert got["0"]["ggb"] is None and got["0"]["ggbseg"] is None
    assert got["0"]["coverage"] == got["0"]["seg"] == 0.0
    assert got["1"]["ggb"] is not None


@pytest.mark.parametrize(
    ("ggb", "seg", "ggbseg", "expected"),
    [
        (0.8, 0.7, 0.9, 0.85),
        (1.4, 0.7, 0.9, 0.9),
        (0.95, 0.7, 1.2, 0.95),
        (1.2, 0.7, 1.1, 0.7),
        (1.0, 0.7, 1.0, 0.7),
        (None, 0.7, 0.9, 0.7),
        (0.8, 0.7, None, 0.7),
        (float("nan"), 0.7, 0.9, 0.7),
        (0.8, 0.8, 0.8, 0.8),
    ],
)
def test_choice_of_coverage(spark, ggb, seg, ggbseg, expected):
    df = spark.createDataFrame([(ggb, seg, ggbseg)], "ggb double, seg double, ggbseg double")
    assert D.choose_coverage(D.combine_methods(df)).first()["coverage"] == pytest.approx(expected)


def test_mid_population_pairs_cohorts(spark):
    rows = spark.createDataFrame(
        [("11", "f", x, 2000, 2010, float(x + 1), float(1000 + x), 0.0, 0.0) for x in BANDS], DDL
    )
    got = {r["age_band"]: r["pop_mid"] for r in cohort_mid_population(rows).collect()}
    assert got[0] == pytest.approx(math.sqrt(1 * 1010))
    assert got[70] == got[80] == pytest.approx(math.sqrt(71 * 1080))
    assert got[75] == got[65] == pytest.approx(math.sqrt(66 * 1075))


def test_growth_of_the_population_over_an_age(spark):
    rows = spark.createDataFrame(stable_rows("11", "f", 0.8, 1.0), DDL)
    assert all(r["rx"] == pytest.approx(0.02) for r in growth_rates(rows).collect())


CELL = "year int, geo_code string, sex string, age_band int"


def test_method_input(spark):
    pop = spark.createDataFrame(
        [(2000, "11", "f", 0, 10), (2010, "11", "f", 0, 20), (2000, "11", "f", 80, 5), (2005, "11", "f", 0, 99)],
        f"{CELL}, pop long",
    )
    deaths = spark.createDataFrame(
        [
            (2000, "11", "f", 0, 4.0),
            (2010, "11", "f", 0, 6.0),
            (2000, "11", "f", 85, 3.0),
            (2010, "11", "f", 80, 8.0),
            (2010, "11", "f", 5, 50.0),
            (2000, None, "f", 0, 70.0),
            (2000, "99", "f", 0, 70.0),
        ],
        f"{CELL}, n double",
    )
    out = D.ddm_input(deaths, pop, 2000, 2010)
    rows = {r["age_band"]: (r["pop1"], r["pop2"], r["deaths"]) for r in out.collect()}
    assert {r["geo_code"] for r in out.collect()} == {"11"}
    assert sorted(rows) == list(BANDS)
    assert rows[0] == (10.0, 20.0, 5.0)
    # the open band takes the deaths at 85; in 2010 it has no population, so its deaths have no partner
    assert rows[80] == (5.0, 0.0, 1.5)
    # deaths in a band without any population drop out, as in the joined table
    assert rows[5] == (0.0, 0.0, 0.0)
    joined = D.deaths_population(deaths, pop)
    assert {tuple(r[:4]) for r in joined.collect()} == {tuple(r[:4]) for r in pop.collect()}


def test_bands_off_the_grid_are_folded_onto_it(spark):
    pop = spark.createDataFrame([(y, "11", "f", b, 1000) for y in (2000, 2010) for b in BANDS] + [(2000, "11", "f", 3, 5)], f"{CELL}, pop long")
    deaths = spark.createDataFrame([(2000, "11", "f", 4, 7.0), (2010, "11", "f", 0, None)], f"{CELL}, n double")
    rows = D.ddm_input(deaths, pop, 2000, 2010)
    got = {r["age_band"]: r for r in cohort_mid_population(rows).collect()}
    assert sorted(got) == list(BANDS)
    assert got[0]["pop1"] == 1005.0 and got[0]["deaths"] is None and got[5]["deaths"] == 0.0
    assert got[0]["pop_mid"] == pytest.approx(math.sqrt(1005 * 1000)) and got[5]["pop_mid"] == pytest.approx(1000)


def test_tables_by_sex_need_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ages = spark.createDataFrame(stable_rows("11", "f", 0.8, 1.0), DDL).drop("e_open").repartition("geo_code", "sex")
        points = D.method_points(ages)
        for table in ([("f", 8.0)], "sex string, e_open double"), ([("f", 0.5, 8.0), ("f", 1.0, 7.0)], "sex string, ratio double, e_open double"):
            text = D.with_e_open(points, spark.createDataFrame(*table))._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(sex" not in text and "Join" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="twice"):
        D.attach_e_open(ages, spark.createDataFrame([("f", 8.0), ("f", 7.0)], "sex string, e_open double"))


def test_settings_reach_the_estimate(spark, noisy_rows):
    rows = D.method_points(spark.createDataFrame(noisy_rows, DDL))
    own = D.with_death_coverage(rows, seg_ages=None, summary="median")
    fitted = D.seg(D.ggb(rows), None, "median")
    assert by_geo(own.where("age_band = 0"), "seg") == by_geo(fitted.where("age_band = 0"), "seg")


def test_e_open_from_levels(spark):
    levels = dims.e_open_levels_table(spark, {"f": [(0.5, 9.0), (1.0, 8.0), (2.0, 5.0)]})
    base = [
        # place, deaths at 10-39, deaths at 40-59
        ("low", 1.0, 10.0), ("knot", 10.0, 10.0), ("between", 15.0, 10.0), ("high", 90.0, 10.0), ("none", 1.0, 0.0),
    ]
    rows = [
        (geo, sex, x, 2000, 2010, 1.0, 1.0, young / 6 if 10 <= x < 40 else old / 4 if 40 <= x < 60 else 0.0, 0.0)
        for geo, young, old in base
        for sex in ("f", "unlisted")
        for x in BANDS
    ]
    df = D.method_points(spark.createDataFrame(rows, DDL).drop("e_open"))
    out = D.e_open_from_levels(df, levels)
    assert out.count() == len(rows)
    got = by_geo(out.where("age_band = 0 AND sex = 'f'"), "e_open")
    assert got == {"low": 9.0, "knot": pytest.approx(8.0), "between": pytest.approx(6.5), "high": 5.0, "none": None}
    assert {r[0] for r in out.where("sex = 'unlisted'").select("e_open").distinct().collect()} == {None}


def test_e_open_by_place_or_by_sex(spark):
    ages = spark.createDataFrame(stable_rows("11", "f", 0.8, 1.0), DDL).drop("e_open")
    by_sex = dims.e_open_table(spark, {"f": 8.0})
    by_place = spark.createDataFrame([("11", "f", 6.5)], "geo_code string, sex string, e_open double")
    assert {r["e_open"] for r in D.attach_e_open(ages, by_sex).collect()} == {8.0}
    assert {r["e_open"] for r in D.attach_e_open(ages, by_place).collect()} == {6.5}


def test_long_table_takes_the_methods_asked_for(covered):
    cover = D.death_coverage(covered)
    assert D.coverage_long(cover).count() == 6 * 5
    assert {r["method"] for r in D.coverage_long(cover, ["ggb", "mean_2"]).collect()} == {"ggb", "mean_2"}
