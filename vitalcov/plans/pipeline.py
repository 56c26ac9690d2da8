"""The whole job in three steps, each of which saves its tables before the next one starts.

Raw records are read once, by the first step; a lost executor or a failed later step never sends
the job back to them. All paths are folders under one root on shared storage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcov.functions import scalars as S
from vitalcov.operators import coverage as C
from vitalcov.operators import ddm as D
from vitalcov.operators.checks import missing_bands, observe_records, quality_rows, unmatched_keys
from vitalcov.operators.redistribute import redistribute_unknown, redistribution_mass
from vitalcov.operators.tabulate import CELL, code_lookup, population_counts, slim_births, slim_deaths, tabulate_events
from vitalcov.plans.estimate import age_rows, event_bands, neighbour_years, smooth_counts
from vitalcov.schemas import SCHEMAS
from vitalcov.sources.dims import SEX_LABELS
from vitalcov.sources.tables import read_table, write_table


@dataclass(frozen=True)
class Job:
    """Where the tables go, which two years are compared, and whether the estimation uses
    averages of the counts over ``span`` years instead of single years.

    ``read_years`` are the years to read events of: with smoothing also the neighbours of the two years. Results stand
    in folders of the pair of years, since every estimate depends on both.
    """

    root: str
    years: tuple[int, int]
    smooth: bool = False
    span: int = 3

    @property
    def read_years(self) -> tuple[int, ...]:
        return neighbour_years(self.years, self.span) if self.smooth else self.years

    def pair(self, table: str) -> str:
        return f"{table}/{self.years[0]}-{self.years[1]}{'-smooth' if self.smooth else ''}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, schema: str, rebalance: bool = False) -> None:
        write_table(df, self.path(table), schema, rebalance)

    def load(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        return read_table(spark, self.path(table), schema)


def count_records(
    job: Job,
    deaths_raw: DataFrame,
    births_raw: DataFrame,
    population_raw: DataFrame,
    codebook: Mapping[str, str] | DataFrame | None = None,
    keep_records: bool = False,
    place: Column | None = None,
    breaks: Sequence[int] | None = None,
) -> None:
    """Step 1: records and population to counts. With ``keep_records`` the slim records are saved
    too, and the counts are then made from the saved files. ``place``: the expression of a record's place, its state if not given.

    ``breaks`` are the lower bounds of the bands that deaths are counted in, for a grid of ages other than five-year ones; the labels of the population tell its own.

    The pass that counts the records also counts their faults (bad ages, codes and dates), saved as ``record_quality``."""
    codebook = code_lookup(SEX_LABELS if codebook is None else codebook, "sex_code", "sex")
    observed = {}
    for kind, raw, slim in (("deaths", deaths_raw, slim_deaths), ("births", births_raw, slim_births)):
        watched, observed[kind] = observe_records(raw, kind, codebook)
        rows = slim(watched, codebook, place)
        if keep_records:
            job.save(rows, f"{kind}_records", "records", rebalance=True)
            rows = job.load(rows.sparkSession, f"{kind}_records", "records")
        job.save(tabulate_events(rows, breaks=breaks if kind == "deaths" else None), f"{kind}_counts", "counts")
    found = quality_rows({kind: seen.get for kind, seen in observed.items()})
    write_table(deaths_raw.sparkSession.createDataFrame(found, SCHEMAS["record_quality"]), job.path(job.pair("record_quality")), "record_quality")
    job.save(population_counts(population_raw, job.years), "population", "population")


def spread_unknowns(spark: SparkSession, job: Job) -> None:
    """Step 2: counts of unknown sex or age spread over the known ones.

    ``spread_mass`` says per kind, year and place how much could not be spread.
    """
    masses = []
    for kind in ("deaths", "births"):
        counts = job.load(spark, f"{kind}_counts", "counts").where(_of(job.read_years) | F.col("year").isNull())
        job.save(redistribute_unknown(counts), kind, "spread_counts")
        masses.append(redistribution_mass(counts).withColumn("kind", F.lit(kind)))
    write_table(masses[0].unionByName(masses[1]), job.path(job.pair("spread_mass")), "spread_mass")


def _of(years: Sequence[int]) -> Column:
    return F.col("year").isin(*years)


def lost_deaths(deaths: DataFrame, pop: DataFrame, years: Sequence[int], bands: Sequence[int]) -> DataFrame:
    """Cells of only one side: deaths without a population, with their number, and population without deaths (``n`` NULL).

    Bands are folded onto the grid first, as the method input does.
    """
    band = S.onto_grid("age_band", bands)
    died = deaths.where(_of(years)).withColumn("age_band", band).groupBy(*CELL).agg(F.sum(F.col("n").cast("double")).alias("n"))
    people = pop.where(_of(years)).withColumn("age_band", band).select(*CELL).distinct()
    return unmatched_keys(died, people, CELL).join(died, list(CELL), "left").withColumn("n", F.when(F.col("side") == "left", F.col("n")))


def estimate(
    spark: SparkSession,
    job: Job,
    e_open: DataFrame | Mapping[str, float],
    geo_dim: DataFrame,
    regions: DataFrame,
    settings: D.Settings = D.Settings(),
) -> None:
    """Step 3: death coverage per method, birth coverage per year, and the ratio of the years by region.

    The age rows are computed and saved once; everything else is made from them. What drops out or is missing on the way is saved
    too: ``unmatched`` cells, ``missing_bands`` and, with smoothing, ``smoothed_years``, the years each average was taken over.
    """
    wanted = {kind: job.load(spark, kind, "spread_counts").where(_of(job.read_years)) for kind in ("deaths", "births")}
    gaps = [missing_bands(df.where(_of(job.years)), settings.bands).withColumn("kind", F.lit(kind)) for kind, df in wanted.items()]
    write_table(gaps[0].unionByName(gaps[1]), job.path(job.pair("missing_bands")), "missing_bands")
    if job.smooth:
        told = []
        for kind, df in wanted.items():
            held = sorted(r["year"] for r in df.select("year").distinct().collect())
            smooth = smooth_counts(df, held, job.years, event_bands(settings.bands), job.span)
            job.save(smooth, job.pair(f"{kind}_smoothed"), "spread_counts")
            wanted[kind] = job.load(spark, job.pair(f"{kind}_smoothed"), "spread_counts")
            told += [(kind, year, len([y for y in held if abs(y - year) <= job.span // 2])) for year in job.years]
        write_table(spark.createDataFrame(told, SCHEMAS["smoothed_years"]), job.path(job.pair("smoothed_years")), "smoothed_years")
    deaths, births = wanted["deaths"], wanted["births"]
    pop = job.load(spark, "population", "population").where(_of(job.years))
    write_table(lost_deaths(deaths, pop, job.years, settings.bands), job.path(job.pair("unmatched")), "unmatched")
    job.save(age_rows(deaths, pop, e_open, *job.years, settings), job.pair("age_rows"), "age_rows")
    ages = job.load(spark, job.pair("age_rows"), "age_rows")
    job.save(D.coverage_long(D.death_coverage(ages)), job.pair("death_coverage"), "method_coverage")
    estimates = C.birth_coverage(C.implied_birth_rate(ages), C.births_total(births, job.years), job.years)
    job.save(estimates, job.pair("estimates"), "estimates")
    ratios = C.coverage_ratio(job.load(spark, job.pair("estimates"), "estimates"), *job.years)
    job.save(C.attach_regions(ratios, geo_dim, regions), job.pair("region_result"), "region_result")


def display_order(df: DataFrame, geo_dim: DataFrame, by: Sequence[str] = ("sex", "year")) -> DataFrame:
    """A small final table sorted for reading: places in the order of the dimension table."""
    return C.with_names(df, geo_dim).orderBy("geo_ord", *[c for c in by if c in df.columns])
