"""Places on several levels, faults of records observed on the way, life tables per place, and tables through storage."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F
from synthetic import BANDS, DDL, stable_population

import registry
from vitalcov.functions import scalars as S
from vitalcov.operators import checks
from vitalcov.operators import ddm as D
from vitalcov.operators import tabulate as T
from vitalcov.plans import pipeline as P
from vitalcov.schemas import SCHEMAS
from vitalcov.sources import dims, scratch
from vitalcov.sources import tables as IO


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# levels -----------------------------------------------------------------------------------------


def placed(n=400):
    rnd = random.Random(7)
    codes = ["1100015", "110002", "1200013", "120001", "2100055", "3550308", "12", None, "BR"]
    return [(rnd.choice([2000, 2010]), rnd.choice(codes), rnd.choice(["f", "m", None]), rnd.choice([3.0, 33.0, 90.0, None])) for _ in range(n)]


def test_all_levels_come_from_one_scan(spark, tmp_path):
    rows = placed()
    spark.createDataFrame(rows, "year int, mun_code string, sex string, age double").write.parquet(str(tmp_path / "r"))
    read = spark.read.parquet(str(tmp_path / "r"))
    records = read.select("year", *[c.alias(name) for name, c in T.place_levels().items()], "sex", "age")
    out = T.tabulate_hierarchy(records, ["municipality", "state", "region"])
    text = plan(out)
    assert text.count("FileScan") == 1 and "Join" not in text and text.count("Expand") == 1
    got = {tuple(r[c] for c in ("level", "geo_code", "year", "sex", "age_band")): r["n"] for r in out.collect()}
    want = collections.Counter()
    for year, code, sex, age in rows:
        known = code is not None and code.isdigit() and len(code) in (6, 7)
        band = None if age is None else min(85, int(age) // 5 * 5)
        for level, place in (("municipality", code[:6] if known else None), ("state", code[:2] if known else None), ("region", code[:1] if known else None), ("country", "BR")):
            want[level, place, year, sex, band] += 1
    assert got == want


def test_levels_of_counts_keep_partly_known_places_apart(spark):
    """A state whose municipality is unknown counts for its state; totals of the source are left out on every level."""
    rows = [(2000, "f", 5, "110001", "11", 4), (2000, "f", 5, None, "11", 2), (2000, "f", 5, None, None, 1), (2000, "f", 5, "BR", "BR", 99), (2000, "f", 5, "BR", "11", 98)]
    cells = spark.createDataFrame(rows, "year int, sex string, age_band int, town string, state string, n long")
    rows = T.with_levels(cells, "n", ["town", "state"]).collect()
    assert len(rows) == 5
    assert {(r["level"], r["geo_code"]): r["n"] for r in rows} == {("town", "110001"): 4, ("town", None): 3, ("state", "11"): 6, ("state", None): 1, ("country", "BR"): 7}
    assert T.with_levels(cells.where("false"), "n", ["town"]).collect() == []
    with pytest.raises(ValueError, match="levels"):
        T.with_levels(cells, "n", [])


def test_redistribution_works_on_every_level(spark):
    from vitalcov.operators.redistribute import redistribute_unknown

    cells = spark.createDataFrame([(2000, s, a, "1", n) for s, a, n in (("f", 0, 4), ("m", 0, 4), (None, 0, 2), ("f", None, 2))], "year int, sex string, age_band int, town string, n long")
    levels = T.with_levels(cells, "n", ["town"])
    out = redistribute_unknown(levels, by=("year", "level", "geo_code")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    assert {r["level"]: round(r["n"], 9) for r in out} == {"town": 12.0, "country": 12.0}


def test_population_on_levels_leaves_the_source_totals_out(spark):
    raw = spark.createDataFrame([(2000, g, "Male", "From 0 to 4 years", 5) for g in ("11", "12", "21", "BR")] + [(2000, "11", "Male", "Total", 50)], SCHEMAS["population_raw"])
    out = T.population_hierarchy(raw, {"state": F.col("geo_code"), "region": F.substring("geo_code", 1, 1)})
    assert {(r["level"], r["geo_code"]): r["pop"] for r in out.collect()} == {
        ("state", "11"): 5, ("state", "12"): 5, ("state", "21"): 5, ("region", "1"): 10, ("region", "2"): 5, ("country", "BR"): 15,
    }


def test_municipality_codes(spark):
    rows = spark.createDataFrame([("1100015",), (" 110001 ",), ("11000",), ("x10001",), (None,)], "c string")
    assert [r[0] for r in rows.select(S.municipality_code(F.col("c"))).collect()] == ["110001", "110001", None, None, None]


# faults -----------------------------------------------------------------------------------------

DEATHS = [
    ("1100015", "1", "70", datetime.date(2000, 6, 1), 2000),
    ("1100015", "2", "ign", datetime.date(2000, 6, 1), 2000),
    ("110", "7", "130", None, 2000),
    (None, None, None, datetime.date(2010, 6, 1), 2000),
    ("x100015", "1", "-1", datetime.date(2010, 1, 1), 2010),
    ("1100015", "1", "NaN", None, 2010),
]
FAULTS = {"records": 6, "no_age": 1, "bad_age": 1, "age_outside": 3, "bad_sex": 2, "bad_place": 3, "undated": 2, "filed_elsewhere": 1}
BIRTHS = [("110001", "1", "25", 2000), ("110001", "0", "x", 2010), ("1", "2", None, 2010)]
BIRTH_FAULTS = {"records": 3, "no_age": 1, "bad_age": 1, "age_outside": 0, "bad_sex": 1, "bad_place": 1}


def test_faults_by_a_scan_of_their_own(spark):
    for kind, rows, want in (("deaths", DEATHS, FAULTS), ("births", BIRTHS, BIRTH_FAULTS)):
        raw = spark.createDataFrame(rows, SCHEMAS[f"{kind}_raw"])
        got = checks.record_quality(raw, kind, dims.SEX_LABELS).collect()
        assert {r["metric"]: r["n"] for r in got} == want and {r["kind"] for r in got} == {kind}
        assert {r["n"] for r in checks.record_quality(raw.where("false"), kind, dims.SEX_LABELS).collect()} == {0}


def test_records_without_a_year_column_are_not_filed(spark):
    raw = spark.createDataFrame(DEATHS, SCHEMAS["deaths_raw"]).drop("year")
    assert "filed_elsewhere" not in {r["metric"] for r in checks.record_quality(raw, "deaths", dims.SEX_LABELS).collect()}


@pytest.mark.parametrize("keep", [False, True])
def test_the_job_finds_the_faults_without_a_second_scan(spark, tmp_path, keep):
    read = {kind: spark.sparkContext.accumulator(0) for kind in ("deaths", "births")}

    def counted(kind, rows):
        seen = read[kind]

        def tell(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        raw = spark.createDataFrame(rows, SCHEMAS[f"{kind}_raw"])
        return raw.mapInPandas(tell, raw.schema)

    people = spark.createDataFrame([(y, "11", "Male", "From 0 to 4 years", 5) for y in (2000, 2010)], SCHEMAS["population_raw"])
    job = P.Job(str(tmp_path), (2000, 2010))
    P.count_records(job, counted("deaths", DEATHS), counted("births", BIRTHS), people, keep_records=keep)
    assert {kind: seen.value for kind, seen in read.items()} == {"deaths": len(DEATHS), "births": len(BIRTHS)}
    found = job.load(spark, job.pair("record_quality"), "record_quality").collect()
    assert {(r["kind"], r["metric"]): r["n"] for r in found} == {("deaths", m): n for m, n in FAULTS.items()} | {("births", m): n for m, n in BIRTH_FAULTS.items()}


def test_misfiled_deaths(spark, tmp_path):
    rows = [("1100015", "1", "70", datetime.date(dated, 6, 1) if dated else None, filed) for filed, dated in ((2000, 2000), (2001, 2000), (2001, 2000), (2000, 1999), (1990, 1991), (2000, None))]
    spark.createDataFrame(rows, SCHEMAS["deaths_raw"]).write.partitionBy("year").parquet(str(tmp_path / "d"))
    found = IO.misfiled_deaths(spark, str(tmp_path / "d"), [2000, 2010])
    assert {tuple(r) for r in found.collect()} == {(2001, 2000, 2), (2000, 1999, 1)}
    assert "ReadSchema: struct<death_date:date>" in plan(found)


def test_a_job_on_another_grid(spark, tmp_path):
    bands = (0, 1, *range(5, 85, 5))
    ages = stable_population(bands, "11", "Masculino", 0.8, 1.0, births=3000)
    died = [("1100015", "1", str(r[2]), datetime.date(y, 6, 1)) for r in ages for y in (2000, 2010) for _ in range(round(r[7]))]
    label = {x: f"From {x} to {top - 1} years" for x, top in zip(bands, bands[1:])} | {80: "From 80 years or more"}
    people = [(y, "11", "Male", label[r[2]], round(r[i])) for r in ages for y, i in ((2000, 5), (2010, 6))]
    job, settings = P.Job(str(tmp_path), (2000, 2010)), D.Settings(bands=bands)
    born = spark.createDataFrame([("110001", "1", "25", y) for y in (2000, 2010) for _ in range(50)], SCHEMAS["births_raw"])
    P.count_records(job, spark.createDataFrame(died, SCHEMAS["deaths_raw"].removesuffix(", year int")), born, spark.createDataFrame(people, SCHEMAS["population_raw"]), breaks=bands)
    P.spread_unknowns(spark, job)
    P.estimate(spark, job, {"Masculino": ages[0][8]}, dims.geo_dim(spark), spark.createDataFrame([("11", "Norte", None)], SCHEMAS["regions"]), settings)
    rows = job.load(spark, job.pair("age_rows"), "age_rows").where("geo_code = '11'").collect()
    assert sorted(r["age_band"] for r in rows) == list(bands)
    assert rows[0]["ggbseg"] == pytest.approx(0.8, rel=0.1)


# life tables per place --------------------------------------------------------------------------

LEVELS = "geo_code string, sex string, ratio double, e_open double"


def rows_of_ratio(geo, ratio, sex="f"):
    return [(geo, sex, x, 2000, 2010, 1.0, 1.0, ratio / 6 if 10 <= x < 40 else 0.25 if 40 <= x < 60 else 0.0, 0.0) for x in BANDS]


def test_levels_of_places_equal_levels_by_sex(spark):
    steps = [(0.5, 9.0), (1.0, 8.0), (2.0, 5.0)]
    ratios = {"low": 0.1, "first": 0.5, "knot": 1.0, "between": 1.5, "last": 2.0, "high": 9.0}
    ages = D.method_points(spark.createDataFrame([r for g, x in ratios.items() for r in rows_of_ratio(g, x)], DDL).drop("e_open"))
    by_place = spark.createDataFrame([(g, "f", r, e) for g in ratios for r, e in steps], LEVELS)
    want, got = (D.with_e_open(ages, levels) for levels in (dims.e_open_levels_table(spark, {"f": steps}), by_place))
    pick = lambda df: {(r["geo_code"], r["age_band"]): r["e_open"] for r in df.collect()}
    assert pick(got) == pytest.approx(pick(want)) and len(pick(got)) == len(ratios) * len(BANDS)
    text = plan(got)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_places_without_levels_or_ratio_have_no_value(spark):
    rows = rows_of_ratio("none", 1.0) + rows_of_ratio("one", 1.0) + [(*r[:7], 0.0, 0.0) for r in rows_of_ratio("still", 1.0)] + [(None, *r[1:]) for r in rows_of_ratio("x", 1.0)]
    ages = D.method_points(spark.createDataFrame(rows, DDL).drop("e_open"))
    levels = spark.createDataFrame([("one", "f", 3.0, 7.0), ("still", "f", 1.0, 7.0), ("one", "f", None, 1.0), ("one", "m", 1.0, 2.0), ("more", "f", 1.0, 3.0)], LEVELS)
    out = D.with_e_open(ages, levels)
    assert out.count() == len(rows)
    assert {(r["geo_code"], r["e_open"]) for r in out.collect()} == {("none", None), ("one", 7.0), ("still", None), (None, None)}


def test_a_ratio_that_stands_twice_for_a_place_is_refused(spark):
    ages = D.method_points(spark.createDataFrame(rows_of_ratio("one", 1.0), DDL).drop("e_open"))
    levels = spark.createDataFrame([("one", "f", 3.0, 7.0), ("one", "f", 3.0, 6.0)], LEVELS)
    with pytest.raises(Exception, match="stands twice"):
        D.with_e_open(ages, levels).collect()


# storage ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["stored_deaths", "stored_births", "stored_population", "stored_counts"])
def test_other_years_are_not_opened(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert text.count("FileScan") == 1
    pruned = text.split("PartitionFilters:")[1].split("\n")[0]
    assert "year" in pruned and "1996" in pruned
    if name == "stored_deaths":
        assert "GreaterThanOrEqual(death_date,1996-01-01)" in text.split("PushedFilters:")[1].split("\n")[0]


class Session:
    """Of a session, what the folder depends on."""

    def __init__(self, master, folder=None):
        self.master, self.folder, self.sparkContext, self.conf = master, folder, self, self

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.folder or default


def test_folders_on_a_cluster_are_shared_ones():
    one, two = (scratch.shared_folder(Session("yarn", "s3a://bucket/x/"), "t") for _ in range(2))
    assert one != two and one.startswith("s3a://bucket/x/vitalcov-") and one.endswith("/t")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session("yarn"), "t")
    assert scratch.shared_folder(Session("local[2]"), "t").endswith("/t")
