"""Birth-registration coverage from corrected deaths, growth and registered births."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcov.functions import scalars as S
from vitalcov.functions.windows import BY, cum_from_age, strict_total


def adjusted_deaths(df: DataFrame) -> DataFrame:
    """Add ``deaths_adj``, the deaths there would be under full registration."""
    return df.withColumn("deaths_adj", S.ratio(F.col("deaths"), F.col("coverage")))


def adjust_deaths(ages: DataFrame, coverage: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Attach ``coverage`` (one row per place and sex) to the age rows and correct their deaths.

    Every age row is kept; without a coverage its corrected deaths are NULL. Use it for coverage
    that comes from elsewhere: after ``with_death_coverage`` the column is already there.
    """
    return adjusted_deaths(ages.join(coverage.select(*by, "coverage"), list(by), "left"))


def implied_birth_profile(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add, at each age and over, ``deaths_cum``, ``pop_cum``, the death rate ``cdr_adj`` and
    ``birth_rate_implied``, the rate of arrival at that age that deaths plus growth imply.

    A missing value makes the totals at its age and all younger ages missing.
    """
    summed = cum_from_age(
        df.withColumns({"deaths": F.col("deaths_adj"), "pop": F.col("pop_mid")}), ["deaths", "pop"], by
    )
    return (
        summed.withColumn("cdr_adj", S.ratio(F.col("deaths_cum"), F.col("pop_cum")))
        .withColumn("birth_rate_implied", F.col("cdr_adj") + F.col("rx"))
        .select(*by, "age_band", "deaths_cum", "pop_cum", "cdr_adj", "rx", "birth_rate_implied")
    )


def implied_birth_rate(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The age-0 row of ``implied_birth_profile``, computed as plain group totals."""
    totals = df.groupBy(*by).agg(
        strict_total(F.col("deaths_adj")).alias("deaths_cum"),
        strict_total(F.col("pop_mid")).alias("pop_cum"),
        F.max(F.when(F.col("age_band") == 0, F.col("rx"))).alias("rx"),
    )
    return totals.withColumn("cdr_adj", S.ratio(F.col("deaths_cum"), F.col("pop_cum"))).withColumn(
        "birth_rate_implied", F.col("cdr_adj") + F.col("rx")
    )


def births_total(births: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Registered births per year, place and sex, over all ages of the mother."""
    rows = births if years is None else births.where(F.col("year").isin(*years))
    return rows.groupBy("year", *BY).agg(F.sum("n").cast("double").alias("births"))


def birth_coverage(rate: DataFrame, births: DataFrame, years: Sequence[int]) -> DataFrame:
    """Registered birth rate ``cbr`` and ``coverage_b`` for each of ``years``.

    ``coverage_b`` is expected over registered births: above 1 means under-registration. Its inverse
    is given as ``completeness``. A place without births in a year keeps its row, with NULLs.
    """
    wide = births.groupBy(*BY).agg(
        *[F.max(F.when(F.col("year") == y, F.col("births"))).alias(f"_births_{y}") for y in years]
    )
    # joined on the key the rates are partitioned by already; the years become rows afterwards
    per_year = F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"_births_{y}").alias("births")) for y in years])
    cbr, expected = S.ratio(F.col("births"), F.col("pop_cum")), F.col("birth_rate_implied")
    return (
        rate.join(wide, list(BY), "left")
        .select(*BY, "pop_cum", "birth_rate_implied", F.inline(per_year))
        .select(
            *BY,
            "year",
            cbr.alias("cbr"),
            "birth_rate_implied",
            S.ratio(expected, cbr).alias("coverage_b"),
            S.ratio(cbr, expected).alias("completeness"),
        )
    )


def compare_years(est: DataFrame, year1: int, year2: int, by: Sequence[str] = BY) -> DataFrame:
    """Both years' coverage side by side, as ``coverage_y1`` and ``coverage_y2``."""
    at = {"coverage_y1": year1, "coverage_y2": year2}
    return est.groupBy(*by).agg(
        *[F.max(F.when(F.col("year") == y, F.col("coverage_b"))).alias(name) for name, y in at.items()]
    )


def coverage_ratio(est: DataFrame, year1: int, year2: int, by: Sequence[str] = BY) -> DataFrame:
    """Add the year2/year1 ratio, its class, and whether it is missing (a missing one is classed equal)."""
    pair = compare_years(est, year1, year2, by).withColumn(
        "ratio", S.ratio(F.col("coverage_y2"), F.col("coverage_y1"))
    )
    return pair.withColumns(
        {
            "ratio_class": S.ratio_class(F.col("ratio"), year1, year2),
            "is_missing": F.col("ratio").isNull(),
        }
    )


def with_names(df: DataFrame, geo_dim: DataFrame) -> DataFrame:
    """Add place name and display order; an unknown code gets a NULL name."""
    return df.join(geo_dim, "geo_code", "left")


def label_sex(df: DataFrame, labels: Mapping[str, str], default: str) -> DataFrame:
    """Recode the sex column for display."""
    return df.withColumn("sex", S.recode(F.col("sex"), labels, default))


def attach_regions(
    ratios: DataFrame, geo_dim: DataFrame, regions: DataFrame, total: str = "BR"
) -> DataFrame:
    """Ratios of the single places with name, region and boundary; the national rows are left out."""
    single = ratios.where(F.col("geo_code") != total)
    return with_names(single, geo_dim).join(regions, "geo_code", "left").select(
        "geo_code",
        "geo_name",
        "region",
        "sex",
        "ratio_class",
        "coverage_y1",
        "coverage_y2",
        "ratio",
        "geometry",
    )
