"""From counts to birth-registration coverage, in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcov.functions.windows import moving_average
from vitalcov.operators import coverage as C
from vitalcov.operators import ddm as D
from vitalcov.operators.cumulate import cohort_mid_population
from vitalcov.operators.tabulate import CELL, densify

EVENT_BANDS = tuple(range(0, 90, 5))


def event_bands(bands: Sequence[int] = D.BANDS) -> tuple[int, ...]:
    """The bands that counts of events are kept in beside a grid: the grid's, and the open one of the import, from 85 on."""
    return tuple(sorted({*bands, EVENT_BANDS[-1]}))


def neighbour_years(years: Sequence[int], span: int = 3) -> tuple[int, ...]:
    """All years that the centred means of ``years`` draw on."""
    half = span // 2
    return tuple(sorted({y + k for y in years for k in range(-half, half + 1)}))


def smoothed_cells(
    counts: DataFrame, years: Sequence[int], bands: Sequence[int] = EVENT_BANDS, span: int = 3
) -> DataFrame:
    """Counts of ``years`` (those the source holds), dense over years and bands for every place and sex, with ``n_smooth``,
    their centred moving average, and ``n_years``, the number of years it was taken over.

    A cell without an event counts 0, also in a year in which its place and sex had none at all. Only the rows of ``years`` are read.
    """
    rows = counts.where(F.col("year").isin(*years))
    by_band = densify(rows, {"n": F.col("n")}, bands)
    cells = densify(by_band, {"n": F.col("n")}, sorted(set(years)), ("geo_code", "sex", "age_band"), "year")
    return moving_average(cells.select(*CELL, "n"), "n", span=span)


def smooth_counts(
    counts: DataFrame,
    years: Sequence[int],
    wanted: Sequence[int] | None = None,
    bands: Sequence[int] = EVENT_BANDS,
    span: int = 3,
) -> DataFrame:
    """The counts of the ``wanted`` years replaced by their centred moving average, with ``n_years``.

    ``years`` are the years that the source holds among the neighbours of the wanted ones: at an end of the series the mean is over
    fewer years, and ``n_years`` says so.
    """
    wanted = years if wanted is None else wanted
    near = [y for y in years if y in neighbour_years(wanted, span)]
    smooth = smoothed_cells(counts, near, bands, span).where(F.col("year").isin(*wanted))
    return smooth.select(*CELL, F.col("n_smooth").alias("n"), "n_years")


def age_rows(
    deaths: DataFrame,
    pop: DataFrame,
    e_open: DataFrame | Mapping[str, float],
    year1: int,
    year2: int,
    settings: D.Settings = D.Settings(),
) -> DataFrame:
    """Age rows with growth, methods, chosen coverage, corrected deaths and mid-period population.

    One chain of windows over (place, sex): deaths and population are read once, and no derived
    table is joined back to the rows it came from. ``e_open`` is a table of values or of levels.
    """
    s = settings
    widths = {b - a for a, b in zip(s.bands, s.bands[1:])}
    years = None if len(widths) == 1 else s.shift * D.common_width(s.bands)
    rows = cohort_mid_population(D.ddm_input(deaths, pop, year1, year2, s.bands), s.shift, s.switch_age, years=years)
    points = D.with_e_open(D.method_points(rows, bands=s.bands), e_open)
    covered = D.with_death_coverage(points, s.search, s.seg_ages, s.ggbseg_ages, s.summary, bands=s.bands, rescale=s.rescale)
    return C.adjusted_deaths(covered)


def estimate_birth_coverage(
    deaths: DataFrame,
    births: DataFrame,
    pop: DataFrame,
    e_open: DataFrame | Mapping[str, float],
    years: Sequence[int],
    settings: D.Settings = D.Settings(),
) -> DataFrame:
    """Coverage of birth registration per place, sex and each of the two ``years``.

    ``deaths`` and ``births`` are redistributed counts, ``pop`` is population by cell. Sex and year
    are key columns, so both sexes and both years come out of the same plan.
    """
    year1, year2 = years
    rate = C.implied_birth_rate(age_rows(deaths, pop, e_open, year1, year2, settings))
    return C.birth_coverage(rate, C.births_total(births, years), years)
