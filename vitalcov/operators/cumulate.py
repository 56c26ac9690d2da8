"""Growth rates and mid-period population of each place and sex."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcov.functions import scalars as S
from vitalcov.functions.windows import BY, by_age, cum_from_age, whole_group


def growth_rates(df: DataFrame, by: Sequence[str] = BY, age: str = "age_band") -> DataFrame:
    """Add ``rx``, the yearly growth rate of the population at each age and over."""
    rate = S.annual_log_growth(F.col("pop2_cum"), F.col("pop1_cum"), F.col("year2") - F.col("year1"))
    return cum_from_age(df, ["pop1", "pop2"], by, age).withColumn("rx", rate).drop("pop1_cum", "pop2_cum")


def cohort_mid_population(
    df: DataFrame,
    shift: int = 2,
    switch_age: int = 75,
    by: Sequence[str] = BY,
    age: str = "age_band",
    years: int | None = None,
) -> DataFrame:
    """Add ``pop_mid``, the geometric mean of a cohort's size at the two counts.

    Below ``switch_age`` the first count is paired with the second one ``shift`` bands later, from
    there on the second count with the first one ``shift`` bands earlier. The last bands therefore
    share pairs with those two bands below them. Needs every band of every group (see ``densify``).

    On bands of different widths no other band holds the same cohort: with ``years`` the partner of a band is what the other count has in the span of ages
    so many years further on (or back), bands being taken as evenly filled; a span that reaches into the open band takes it whole, and the open band is as wide as the one below it.
    """
    if years is not None:
        return _cohorts_of_uneven_bands(df, years, switch_age, by, age)
    ages = by_age(by, age)
    ahead = S.geometric_mean(F.col("pop1"), F.lead("pop2", shift).over(ages))
    behind = S.geometric_mean(F.lag("pop1", shift).over(ages), F.col("pop2"))
    return df.withColumn("pop_mid", F.when(F.col(age) < switch_age, ahead).otherwise(behind))


def _cohorts_of_uneven_bands(df: DataFrame, years: int, switch_age: int, by: Sequence[str], age: str) -> DataFrame:
    ages, whole = by_age(by, age), whole_group(by, age)
    here, older, younger = F.col(age), F.lead(age).over(ages), F.lag(age).over(ages)
    placed = df.withColumns({"_width": F.coalesce(older - here, here - younger), "_open": older.isNull()})
    # a group has one entry for each of its bands
    entry = F.struct(here.alias("from"), (here + F.col("_width")).alias("to"), F.col("_open").alias("open"), "pop1", "pop2")
    listed = placed.withColumn("_bands", F.collect_list(entry).over(whole))

    def within(count: str, low: Column) -> Column:
        high = low + F.col("_width")

        def part(b: Column) -> Column:
            shared = F.greatest(F.least(high, b["to"]) - F.greatest(low, b["from"]), F.lit(0)) / (b["to"] - b["from"])
            return F.when(b["open"] & (high > b["from"]), F.lit(1.0)).when(b["open"], F.lit(0.0)).otherwise(shared)

        def more(total: Column, b: Column) -> Column:
            # a missing count outside the span does not matter
            return total + F.when(part(b) > 0, b[count] * part(b)).otherwise(0.0)

        return F.when((low >= 0) & F.exists("_bands", lambda b: b["to"] > low), F.aggregate("_bands", F.lit(0.0), more))

    ahead = S.geometric_mean(F.col("pop1"), within("pop2", here + F.lit(years)))
    behind = S.geometric_mean(within("pop1", here - F.lit(years)), F.col("pop2"))
    mid = F.when(here < switch_age, ahead).otherwise(behind)
    return listed.withColumn("pop_mid", mid).drop("_width", "_open", "_bands")
