"""Window specifications and window sums shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BY = ("geo_code", "sex")


def by_age(by: Sequence[str] = BY, age: str = "age_band") -> WindowSpec:
    """The age rows of one group, youngest first.

    Every window over a group is built on this one ordering, also those that do not need it: Spark
    merges neighbouring windows of equal partitioning and ordering into one operator and one sort.
    """
    return Window.partitionBy(*by).orderBy(age)


def whole_group(by: Sequence[str] = BY, age: str = "age_band") -> WindowSpec:
    """All ages of the group."""
    return by_age(by, age).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def from_age_on(by: Sequence[str] = BY, age: str = "age_band") -> WindowSpec:
    """This age and every older one."""
    return by_age(by, age).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def below_age(by: Sequence[str] = BY, age: str = "age_band") -> WindowSpec:
    """Every younger age."""
    return by_age(by, age).rowsBetween(Window.unboundedPreceding, -1)


def _null_as_nan(col: Column) -> Column:
    # a NaN summand makes the whole sum NaN, which is how the missing value is carried through
    return F.coalesce(col.cast("double"), F.lit(float("nan")))


def strict_sum(col: Column, window: WindowSpec) -> Column:
    """Window sum that is NULL as soon as one summand is, unlike the built-in one."""
    return F.nullif(F.sum(_null_as_nan(col)).over(window), F.lit(float("nan")))


def strict_total(col: Column) -> Column:
    """Group sum that is NULL as soon as one summand is."""
    return F.nullif(F.sum(_null_as_nan(col)), F.lit(float("nan")))


def cum_from_age(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = BY, age: str = "age_band"
) -> DataFrame:
    """Add ``<col>_cum``, the total at each age and over, for every column in ``cols``."""
    window = from_age_on(by, age)
    return df.withColumns({f"{c}_cum": strict_sum(F.col(c), window) for c in cols})


def moving_average(
    df: DataFrame,
    value: str = "n",
    by: Sequence[str] = ("geo_code", "sex", "age_band"),
    year: str = "year",
    span: int = 3,
) -> DataFrame:
    """Add ``<value>_smooth``, the mean over the ``span`` calendar years centred on each year.

    The frame counts calendar years, not rows, so a year without a row never pulls in a farther one.
    At both ends of the series the mean is over the years that exist; ``<value>_years`` says how many.
    """
    if span % 2 == 0:
        raise ValueError("a centred moving average needs an odd span")
    half = span // 2
    window = Window.partitionBy(*by).orderBy(year).rangeBetween(-half, half)
    return df.withColumns(
        {
            f"{value}_smooth": F.avg(value).over(window),
            f"{value}_years": F.count(value).over(window).cast("int"),
        }
    )
