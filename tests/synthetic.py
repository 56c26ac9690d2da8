"""A closed stable population with Gompertz mortality, for which coverage is known exactly."""

from __future__ import annotations

import math

BANDS = tuple(range(0, 85, 5))
DDL = (
    "geo_code string, sex string, age_band int, year1 int, year2 int, "
    "pop1 double, pop2 double, deaths double, e_open double"
)


def _survivors(age: float) -> float:
    a, b = 0.0001, 0.09
    return math.exp(-a / b * (math.exp(b * age) - 1))


def _hazard(age: float) -> float:
    return 0.0001 * math.exp(0.09 * age)


def _integral(f, lo: float, hi: float, steps: int = 400) -> float:
    h = (hi - lo) / steps
    return h * sum(f(lo + (i + 0.5) * h) for i in range(steps))


def stable_population(bands, geo: str, sex: str, death_share: float, first_count_share: float, growth=0.02, years=10, births=1e6, density=False):
    """Age rows on any grid, with ``death_share`` of the deaths registered and the first count scaled; with ``density`` (place, sex, age, people per year of age)."""
    if density:
        return [(geo, sex, x, births * math.exp(-growth * x) * _survivors(x)) for x in bands]
    rows = []
    for x, top in zip(bands, (*bands[1:], 130)):
        size = births * _integral(lambda a: math.exp(-growth * a) * _survivors(a), x, top)
        dying = births * _integral(lambda a: math.exp(-growth * a) * _survivors(a) * _hazard(a), x, top)
        mean_factor = (math.exp(growth * years) - 1) / (growth * years)
        rows.append((geo, sex, x, 2000, 2000 + years, size * first_count_share, size * math.exp(growth * years),
                     death_share * dying * mean_factor, _integral(_survivors, bands[-1], 130) / _survivors(bands[-1])))
    return rows


def stable_rows(geo: str, sex: str, death_share: float, first_count_share: float, growth=0.02, years=10, births=1e6):
    """Age rows in bands of five years."""
    return stable_population(BANDS, geo, sex, death_share, first_count_share, growth, years, births)
