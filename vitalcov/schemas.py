"""Declared schemas of every dataset that enters or leaves the library."""

from __future__ import annotations

from pyspark.sql import DataFrame

_CELL = "year int, geo_code string, sex string, age_band int"

SCHEMAS: dict[str, str] = {
    "deaths_raw": "mun_code string, sex_code string, age_years string, death_date date, year int",
    "births_raw": "mun_code string, sex_code string, mother_age string, year int",
    "population_raw": "year int, geo_code string, sex_label string, age_label string, pop bigint",
    "records": "year int, geo_code string, sex string, age double",
    "counts": f"{_CELL}, n bigint",
    "spread_counts": f"{_CELL}, n double",
    "population": f"{_CELL}, pop bigint",
    "ddm_input": (
        "geo_code string, sex string, age_band int, year1 int, year2 int, "
        "pop1 double, pop2 double, deaths double"
    ),
    "e_open": "sex string, e_open double",
    "e_open_levels": "sex string, ratio double, e_open double",
    "method_coverage": "geo_code string, sex string, method string, coverage double",
    "age_rows": (
        "geo_code string, sex string, age_band int, year1 int, year2 int, pop1 double, pop2 double, deaths double, "
        "pop_mid double, rx double, fit_lo int, fit_hi int, ggb double, delta double, seg double, ggbseg double, "
        "mean_3 double, mean_2 double, coverage double, deaths_adj double"
    ),
    "spread_mass": "kind string, year int, geo_code string, n_before double, n_after double, n_lost double",
    "unmatched": f"{_CELL}, side string, n double",
    "missing_bands": f"kind string, {_CELL}",
    "record_quality": "kind string, metric string, n bigint",
    "smoothed_years": "kind string, year int, n_years int",
    "estimates": (
        "geo_code string, sex string, year int, cbr double, "
        "birth_rate_implied double, coverage_b double, completeness double"
    ),
    "geo_dim": "geo_code string, geo_name string, geo_ord int",
    "regions": "geo_code string, region string, geometry binary",
    "region_result": (
        "geo_code string, geo_name string, region string, sex string, ratio_class string, "
        "coverage_y1 double, coverage_y2 double, ratio double, geometry binary"
    ),
}


def columns(name: str) -> dict[str, str]:
    """Column names and types of schema ``name``."""
    return dict(field.split(" ") for field in SCHEMAS[name].split(", "))


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """``df`` reduced to the columns of schema ``name``; raises if one is missing or of another type."""
    have, want = dict(df.dtypes), columns(name)
    wrong = [f"{c}: expected {t}, found {have.get(c, 'nothing')}" for c, t in want.items() if have.get(c) != t]
    if wrong:
        raise ValueError(f"not a {name} table: " + "; ".join(wrong))
    return df.select(*want)
