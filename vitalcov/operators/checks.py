"""Checks that stand in for row-by-row pairing: who has no partner, who has gaps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vitalcov.functions import scalars as S

#: Column of the age and of the date in records of each kind.
RECORDS = {"deaths": ("age_years", "death_date"), "births": ("mother_age", None)}


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with column ``side`` = ``left`` or ``right``.

    A key with a NULL part matches nothing. Both sides are pre-aggregated in one union, so repeated
    or hot keys are folded before the shuffle and nothing fans out as it would in a join.
    """
    marked = left.select(*keys, F.lit(1).alias("_left"), F.lit(0).alias("_right")).unionByName(
        right.select(*keys, F.lit(0).alias("_left"), F.lit(1).alias("_right"))
    )
    seen = marked.groupBy(*keys).agg(F.max("_left").alias("_left"), F.max("_right").alias("_right"))
    broken = F.lit(False)
    for key in keys:
        broken = broken | F.col(key).isNull()
    on_left, on_right = F.col("_left") == 1, F.col("_right") == 1
    sides = F.array_compact(
        F.array(
            F.when(on_left & (broken | ~on_right), F.lit("left")),
            F.when(on_right & (broken | ~on_left), F.lit("right")),
        )
    )
    return seen.select(*keys, F.explode(sides).alias("side"))


def missing_bands(
    df: DataFrame, bands: Sequence[int], by: Sequence[str] = ("year", "geo_code", "sex"), age: str = "age_band"
) -> DataFrame:
    """Missing age bands, one row per group and band.

    One flag per grid band is kept while aggregating, so the state of a group is bounded whatever
    its row count.
    """
    flags = [F.max(F.when(F.col(age) == b, 1)).alias(f"_band_{b}") for b in bands]
    absent = F.array_compact(F.array(*[F.when(F.col(f"_band_{b}").isNull(), F.lit(b)) for b in bands]))
    return df.groupBy(*by).agg(*flags).select(*by, F.explode(absent).alias(age))


def value_range(df: DataFrame, col: str) -> DataFrame:
    """Smallest and largest value of a column over the whole table."""
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def record_faults(kind: str, sex_codes: Iterable[str], columns: Sequence[str], limit: int = 125) -> dict[str, Column]:
    """How many raw records of ``kind`` ("deaths" or "births") are faulty, as one aggregate expression per fault.

    ``records`` is their number. An age may be missing (``no_age``), no number (``bad_age``) or outside ``[0, limit)`` (``age_outside``); a sex code missing or
    not among ``sex_codes`` (``bad_sex``), a municipality code not one of six or seven digits (``bad_place``). Deaths may be without a date (``undated``), and, in
    a source with a ``year`` of its own, dated in another one than they are filed under (``filed_elsewhere``). A record may have several faults.
    """
    age, date = RECORDS[kind]
    number = S.number(F.col(age))
    tests = {
        "no_age": F.col(age).isNull(),
        "bad_age": F.col(age).isNotNull() & number.isNull(),
        "age_outside": (number < 0) | (number >= limit) | F.isnan(number),
        "bad_sex": F.col("sex_code").isNull() | ~F.col("sex_code").isin(*sex_codes),
        "bad_place": S.state_code(F.col("mun_code")).isNull(),
    }
    if date:
        tests["undated"] = F.col(date).isNull()
        if "year" in columns:
            tests["filed_elsewhere"] = F.year(date) != F.col("year")
    return {"records": F.count(F.lit(1)), **{name: F.count(F.when(test, F.lit(1))) for name, test in tests.items()}}


def observe_records(raw: DataFrame, kind: str, sex_codes: Iterable[str]) -> tuple[DataFrame, Observation]:
    """The records, and what the first action over them will have seen of their faults: no second scan is made for the numbers."""
    seen = Observation(f"faults of {kind}")
    return raw.observe(seen, *[c.alias(name) for name, c in record_faults(kind, sex_codes, raw.columns).items()]), seen


def record_quality(raw: DataFrame, kind: str, sex_codes: Iterable[str]) -> DataFrame:
    """One row per fault (``metric``) of the records of ``kind``, with its number ``n``: the same numbers by a scan of their own."""
    faults = record_faults(kind, sex_codes, raw.columns)
    counted = raw.agg(*[c.alias(name) for name, c in faults.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("n")) for name in faults])
    return counted.select(F.lit(kind).alias("kind"), F.inline(rows))


def quality_rows(observed: Mapping[str, Mapping[str, int]]) -> list[tuple[str, str, int]]:
    """Observed numbers as rows of ``record_quality``."""
    return [(kind, metric, n) for kind, found in observed.items() for metric, n in found.items()]
