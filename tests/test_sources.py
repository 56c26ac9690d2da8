import datetime

import pytest
from synthetic import stable_rows

from vitalcov.operators import ddm as D
from vitalcov.operators import tabulate as T
from vitalcov.plans import pipeline as P
from vitalcov.plans.estimate import estimate_birth_coverage
from vitalcov.schemas import SCHEMAS, check_schema
from vitalcov.sources import dims
from vitalcov.sources import tables as IO


def day(year):
    return datetime.date(year, 6, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def deaths(spark):
    rows = [("1100015", "1", "70", day(y)) for y in (1999, 2000, 2010, 2011)]
    return spark.createDataFrame(rows, SCHEMAS["deaths_raw"].removesuffix(", year int"))


def test_deaths_are_filtered_at_the_source(spark, deaths, tmp_path):
    path = str(tmp_path / "deaths")
    deaths.write.parquet(path)
    read = IO.read_deaths(spark, path, [2000, 2010])
    assert sorted(r["death_date"].year for r in read.collect()) == [2000, 2010]
    pushed = plan(read).split("PushedFilters:")[1].split("\n")[0]
    assert "GreaterThanOrEqual(death_date,2000-01-01)" in pushed and "LessThan(death_date,2001-01-01)" in pushed
    assert "ReadSchema: struct<mun_code:string,death_date:date,year:int>" in plan(read.select("mun_code"))


def test_year_folders_of_other_years_are_not_opened(spark, deaths, tmp_path):
    path = str(tmp_path / "deaths")
    deaths.selectExpr("*", "year(death_date) AS year").write.partitionBy("year").parquet(path)
    read = IO.read_deaths(spark, path, [2000, 2010])
    assert sorted(r["death_date"].year for r in read.collect()) == [2000, 2010]
    assert read.columns == [*deaths.columns, "year"]
    assert "year" in plan(read).split("PartitionFilters:")[1].split("]")[0]


def test_deaths_without_a_date_count_for_their_folder(spark, tmp_path):
    rows = [("1100015", "1", "70", day(2000), 2000), ("1100015", "1", "70", None, 2000), ("1100015", "1", "70", day(1990), 2000), ("1100015", "1", "70", None, 1999)]
    raw = spark.createDataFrame(rows, SCHEMAS["deaths_raw"])
    raw.write.partitionBy("year").parquet(str(tmp_path / "folders"))
    read = IO.read_deaths(spark, str(tmp_path / "folders"), [2000, 2010])
    assert [r["year"] for r in T.slim_deaths(read, dims.SEX_LABELS).collect()] == [2000, 2000]
    raw.drop("year").write.parquet(str(tmp_path / "plain"))
    read = IO.read_deaths(spark, str(tmp_path / "plain"), [2000, 2010])
    assert sorted((r["year"] for r in T.slim_deaths(read, dims.SEX_LABELS).collect()), key=str) == [2000, None, None]


def test_births_and_population_from_year_folders(spark, tmp_path):
    births = spark.createDataFrame([("110001", "1", "20", y) for y in (2000, 2005)], SCHEMAS["births_raw"])
    births.write.partitionBy("year").parquet(str(tmp_path / "b"))
    read = IO.read_births(spark, str(tmp_path / "b"), [2000])
    assert [r["year"] for r in read.collect()] == [2000]
    assert "year" in plan(read).split("PartitionFilters:")[1].split("]")[0]
    pop = spark.createDataFrame([(y, "11", "Male", "Total", 1) for y in (2000, 2005)], SCHEMAS["population_raw"])
    pop.write.parquet(str(tmp_path / "p"))
    assert IO.read_population(spark, str(tmp_path / "p"), [2005]).count() == 1


def test_csv_is_read_with_the_declared_schema(spark, tmp_path):
    (tmp_path / "d.csv").write_text("mun_code,sex_code,age_years,death_date\n0100015,1,007,2000-02-03\n355030,2,ign,2000-02-03\n")
    read = IO.read_deaths(spark, str(tmp_path / "d.csv"), [2000], fmt="csv", header="true")
    slim = {r["geo_code"]: (r["year"], r["sex"], r["age"]) for r in T.slim_deaths(read, dims.SEX_LABELS).collect()}
    assert slim == {"01": (2000, "Masculino", 7.0), "35": (2000, "Feminino", None)}


def test_saving_one_year_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "counts")
    for rows in ([(2000, "11", "f", 0, 1), (2010, "11", "f", 0, 2)], [(2010, "11", "f", 5, 9)]):
        IO.write_table(spark.createDataFrame(rows, SCHEMAS["counts"]), path, "counts")
    got = sorted(tuple(r) for r in IO.read_table(spark, path, "counts").collect())
    assert got == [(2000, "11", "f", 0, 1), (2010, "11", "f", 5, 9)]


def test_unknown_sex_and_age_survive_saving(spark, tmp_path):
    rows = [(2000, None, None, None, 1), (2000, "BR", "f", 0, 2)]
    IO.write_table(spark.createDataFrame(rows, SCHEMAS["counts"]), str(tmp_path / "c"), "counts", rebalance=True)
    assert {tuple(r) for r in IO.read_table(spark, str(tmp_path / "c"), "counts").collect()} == set(rows)


def test_regions_carry_bytes(spark, tmp_path):
    rows = [("11", "Norte", bytearray(b"\x00\x01"))]
    IO.write_table(spark.createDataFrame(rows, SCHEMAS["regions"]), str(tmp_path / "r"), "regions")
    assert bytes(IO.read_regions(spark, str(tmp_path / "r")).first()["geometry"]) == b"\x00\x01"


def test_schema_check_names_what_is_wrong(spark):
    with pytest.raises(ValueError, match="n: expected bigint, found double.*|.*age_band: expected int, found nothing"):
        check_schema(spark.createDataFrame([(2000, "11", "f", 1.0)], "year int, geo_code string, sex string, n double"), "counts")


def test_pipeline_end_to_end(spark, tmp_path):
    """Records and population files in, saved results out, equal to the one-plan estimate."""
    ages = [r for sex in ("Masculino", "Feminino") for r in stable_rows("11", sex, 0.8, 1.0, births=2000)]
    code = {"Masculino": "1", "Feminino": "2"}
    died = [
        ("1100015", code[r[1]], str(r[2] + 2), day(y)) for r in ages for y in (2000, 2010) for _ in range(round(r[7]) + 1)
    ] + [("1100015", "9", "ign", day(2000)), ("1200013", "1", "5", day(2010))]
    born = [("110001", s, "25", y) for s in "12" for y in (2000, 2010) for _ in range(30 + y % 7)]
    label = {x: f"From {x} to {x + 4} years" for x in range(0, 80, 5)} | {80: "From 80 years or more"}
    english = {"Masculino": "Male", "Feminino": "Female"}
    people = [
        (y, "11", english[r[1]], label[r[2]], round(r[i])) for r in ages for y, i in ((2000, 5), (2010, 6))
    ] + [(2000, "11", "Male", "Total", 10**9)]
    raw = {
        "deaths_raw": spark.createDataFrame(died, SCHEMAS["deaths_raw"].removesuffix(", year int")),
        "births_raw": spark.createDataFrame(born, SCHEMAS["births_raw"]),
        "population_raw": spark.createDataFrame(people, SCHEMAS["population_raw"]),
    }
    job = P.Job(str(tmp_path), (2000, 2010))
    e_open = dims.e_open_table(spark, {"Masculino": 5.0, "Feminino": 6.0})
    regions = spark.createDataFrame([("11", "Norte", None)], SCHEMAS["regions"])
    P.count_records(job, raw["deaths_raw"], raw["births_raw"], raw["population_raw"], keep_records=True)
    P.spread_unknowns(spark, job)
    P.estimate(spark, job, e_open, dims.geo_dim(spark), regions)

    counted = job.load(spark, "deaths_counts", "counts")
    assert counted.where("geo_code = 'BR'").groupBy().sum("n").first()[0] == len(died)
    assert job.load(spark, "deaths_records", "records").count() == len(died)
    saved = {tuple(r)[:3]: tuple(r)[3:] for r in job.load(spark, job.pair("estimates"), "estimates").collect()}
    direct = estimate_birth_coverage(
        job.load(spark, "deaths", "spread_counts"),
        job.load(spark, "births", "spread_counts"),
        job.load(spark, "population", "population"),
        e_open,
        (2000, 2010),
    )
    want = {tuple(r)[:3]: tuple(r)[3:] for r in direct.collect()}
    assert len(want) == 8 and saved.keys() == want.keys()
    assert all(saved[k] == pytest.approx(want[k]) for k in want)
    result = job.load(spark, job.pair("region_result"), "region_result").collect()
    assert {(r["geo_name"], r["region"], r["sex"]) for r in result} == {
        ("Rondônia", "Norte", "Masculino"),
        ("Rondônia", "Norte", "Feminino"),
    }
    assert job.load(spark, job.pair("death_coverage"), "method_coverage").count() == 20
    shown = P.display_order(job.load(spark, job.pair("estimates"), "estimates"), dims.geo_dim(spark)).collect()
    assert [r["geo_code"] for r in shown] == ["11"] * 4 + ["BR"] * 4
    # what was lost is told: deaths of a state without population, and nothing of the spread
    lost = job.load(spark, job.pair("unmatched"), "unmatched").where("side = 'left'").collect()
    assert [(r["geo_code"], r["n"]) for r in lost] == [("12", 1.0)]
    mass = job.load(spark, job.pair("spread_mass"), "spread_mass")
    assert mass.agg({"n_lost": "max"}).first()[0] == pytest.approx(0.0)
    total = mass.where("kind = 'deaths' AND geo_code <> 'BR'").groupBy().sum("n_after").first()[0]
    kept = job.load(spark, job.pair("age_rows"), "age_rows").where("geo_code <> 'BR'").groupBy().sum("deaths").first()[0]
    assert total == pytest.approx(len(died)) == pytest.approx(2 * kept + 1.0)
    assert job.load(spark, job.pair("missing_bands"), "missing_bands").where("kind = 'births'").count() == 2 * 2 * 2 * 16 + 0


def test_smoothing_job_reads_the_years_around_and_differs(spark, tmp_path):
    ages = stable_rows("11", "Feminino", 0.8, 1.0, births=2000)
    died = [("1100015", "2", str(r[2] + 2), day(y)) for r in ages for y in (1999, 2000, 2001, 2010) for _ in range(round(r[7]) * (1 + y % 2) + 1)]
    born = [("110001", "2", "25", y) for y, n in ((1999, 10), (2000, 40), (2001, 100), (2010, 50)) for _ in range(n)]
    people = [(y, "11", "Female", f"From {r[2]} to {r[2] + 4} years", round(r[i])) for r in ages for y, i in ((2000, 5), (2010, 6))]
    regions = spark.createDataFrame([("11", "Norte", None)], SCHEMAS["regions"])
    results = {}
    for smooth in (False, True):
        job = P.Job(str(tmp_path / str(smooth)), (2000, 2010), smooth=smooth)
        assert job.read_years == ((1999, 2000, 2001, 2009, 2010, 2011) if smooth else (2000, 2010))
        deaths = spark.createDataFrame(died, SCHEMAS["deaths_raw"].removesuffix(", year int"))
        births = spark.createDataFrame(born, SCHEMAS["births_raw"])
        P.count_records(job, deaths, births, spark.createDataFrame(people, SCHEMAS["population_raw"]))
        P.spread_unknowns(spark, job)
        P.estimate(spark, job, {"Feminino": 6.0}, dims.geo_dim(spark), regions, D.Settings())
        rows = job.load(spark, job.pair("estimates"), "estimates").where("geo_code = '11'").collect()
        results[smooth] = {r["year"]: r["cbr"] for r in rows}
    assert results[True][2000] == pytest.approx(results[False][2000] * 50 / 40)
    assert results[True][2010] == pytest.approx(results[False][2010])
    told = job.load(spark, job.pair("smoothed_years"), "smoothed_years").collect()
    assert {(r["kind"], r["year"]): r["n_years"] for r in told} == {(k, y): n for k in ("deaths", "births") for y, n in ((2000, 3), (2010, 1))}


def test_names_with_quotes(spark):
    places = dims.geo_dim(spark, [("11", "Alta Floresta D'Oeste"), ("12", 'a "b"')]).orderBy("geo_ord").collect()
    assert [r["geo_name"] for r in places] == ["Alta Floresta D'Oeste", 'a "b"']
