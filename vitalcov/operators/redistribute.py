"""Pro-rata redistribution of counts whose sex or age is unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalcov.functions import scalars as S


def flag_missing(df: DataFrame, sex: str = "sex", age: str = "age_band") -> DataFrame:
    """Add 0/1 flags ``age_missing``, ``sex_missing`` and ``both_missing``."""
    no_age, no_sex = F.col(age).isNull(), F.col(sex).isNull()
    return df.withColumns(
        {
            "age_missing": no_age.cast("int"),
            "sex_missing": no_sex.cast("int"),
            "both_missing": (no_age & no_sex).cast("int"),
        }
    )


def split_measure(value: Column, missing: Column) -> tuple[Column, Column]:
    """The measure split into its known and its missing part, zero where the other one applies."""
    zero = F.lit(0.0)
    return F.when(missing, zero).otherwise(value), F.when(missing, value).otherwise(zero)


def _share(value: Column, missing: Column, keys: Sequence[str]) -> Column:
    """What a row receives of the missing part of its group, in proportion to its known part."""
    known, unknown = split_measure(value, missing)
    group = Window.partitionBy(*keys)
    weight = S.ratio(known, F.sum(known).over(group))
    return F.sum(unknown).over(group) * F.coalesce(weight, F.lit(0.0))


def spread_unknown(
    df: DataFrame,
    value: str = "n",
    by: Sequence[str] = ("year", "geo_code"),
    sex: str = "sex",
    age: str = "age_band",
) -> DataFrame:
    """Add ``<value>_spread``, the counts after spreading those of unknown sex and age.

    Three passes within each year and place, each in proportion to the counts the previous one
    left: both unknown, over all rows (rows with one unknown included); sex unknown, over the sexes
    of the same band; age unknown, over the bands of the same sex. Rows with an unknown keep what
    they passed on, so they have to be left out of later sums.

    All three groupings contain ``by``, so a single exchange on ``by`` serves them, and a group has
    at most one row per sex and band.
    """
    no_sex, no_age = F.col(sex).isNull(), F.col(age).isNull()
    both = no_sex & no_age
    out = f"{value}_spread"
    known, _ = split_measure(F.col(value).cast("double"), both)
    return (
        df.withColumn(out, known + _share(F.col(value).cast("double"), both, by))
        .withColumn(out, F.col(out) + _share(F.col(out), no_sex, [*by, age]))
        .withColumn(out, F.col(out) + _share(F.col(out), no_age, [*by, sex]))
    )


def redistribute_unknown(
    df: DataFrame,
    value: str = "n",
    by: Sequence[str] = ("year", "geo_code"),
    sex: str = "sex",
    age: str = "age_band",
) -> DataFrame:
    """Counts of known sex and age after ``spread_unknown``.

    A part with no known cell to go to cannot be spread and is lost; ``redistribution_mass`` shows it.
    """
    return (
        spread_unknown(df, value, by, sex, age)
        .where(F.col(sex).isNotNull() & F.col(age).isNotNull())
        .withColumn(value, F.col(f"{value}_spread"))
        .drop(f"{value}_spread")
    )


def redistribution_mass(
    df: DataFrame,
    value: str = "n",
    by: Sequence[str] = ("year", "geo_code"),
    sex: str = "sex",
    age: str = "age_band",
) -> DataFrame:
    """Total per year and place before and after the redistribution, and what could not be spread."""
    kept = F.col(sex).isNotNull() & F.col(age).isNotNull()
    sums = spread_unknown(df, value, by, sex, age).groupBy(*by).agg(
        F.sum(value).cast("double").alias(f"{value}_before"),
        F.sum(F.when(kept, F.col(f"{value}_spread")).otherwise(0.0)).alias(f"{value}_after"),
    )
    return sums.withColumn(f"{value}_lost", F.col(f"{value}_before") - F.col(f"{value}_after"))
