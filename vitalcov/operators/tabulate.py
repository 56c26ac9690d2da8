"""From individual records to counts per year, place, sex and age band."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcov.functions import scalars as S
from vitalcov.functions.windows import strict_total

CELL = ("year", "geo_code", "sex", "age_band")
#: Largest codebook that becomes a lookup.
MOST_CODES = 1000


def decode_codes(df: DataFrame, col: str, codebook: Mapping[str, str] | DataFrame, label: str) -> DataFrame:
    """Replace code column ``col`` by its label, as column ``label``; unknown codes become NULL.

    The codebook becomes a literal lookup, with no join: a join on a handful of codes would bring all records
    together in as many tasks. A codebook table needs a column named ``col`` and one named ``label``; it is
    read into the lookup by ``code_lookup``.
    """
    return df.withColumn(label, S.lookup(F.col(col), code_lookup(codebook, col, label))).drop(col)


def code_lookup(codebook: Mapping[str, str] | DataFrame, col: str, label: str, most: int = MOST_CODES) -> Mapping[str, str]:
    """A codebook table as a mapping; it must have at most ``most`` rows and no code twice."""
    if not isinstance(codebook, DataFrame):
        return codebook
    rows = codebook.where(F.col(col).isNotNull()).select(F.col(col).cast("string"), F.col(label)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a codebook of more than {most} rows")
    found = {r[0]: r[1] for r in rows}
    if len(found) < len(rows):
        raise ValueError(f"a code stands twice in the codebook of {col}")
    return found


Place = Column | Mapping[str, Column] | None


def _slim(raw: DataFrame, year: Column, age: str, codebook: Mapping[str, str] | DataFrame, place: Place) -> DataFrame:
    geo = S.state_code(F.col("mun_code")) if place is None else place
    places = geo if isinstance(geo, Mapping) else {"geo_code": geo}
    sex = S.lookup(F.col("sex_code"), code_lookup(codebook, "sex_code", "sex"))
    return raw.select(year.alias("year"), *[c.alias(name) for name, c in places.items()], sex.alias("sex"), S.number(F.col(age)).alias("age"))


def place_levels(code: str = "mun_code") -> dict[str, Column]:
    """The levels that a municipality code tells: the municipality, its state (two digits) and its region (the first digit)."""
    state = S.state_code(F.col(code))
    return {"municipality": S.municipality_code(F.col(code)), "state": state, "region": F.substring(state, 1, 1)}


def slim_deaths(raw: DataFrame, codebook: Mapping[str, str] | DataFrame, place: Place = None) -> DataFrame:
    """Death records reduced to year of death, place of residence, sex and age in years.

    A record without a date counts for its file's ``year``, where there is such a column. ``place`` is the expression
    of the place, the state of the municipality if not given, or a mapping from names of levels to theirs, as ``place_levels`` gives.
    """
    year = F.year("death_date")
    return _slim(raw, F.coalesce(year, F.col("year")) if "year" in raw.columns else year, "age_years", codebook, place)


def slim_births(raw: DataFrame, codebook: Mapping[str, str] | DataFrame, place: Place = None) -> DataFrame:
    """Birth records reduced to year, place of birth (the state, or ``place``), sex of the child and age of the mother."""
    return _slim(raw, F.col("year"), "mother_age", codebook, place)


def with_age_band(
    df: DataFrame, age: str = "age", width: int = 5, limit: int = 125, open_age: int = 85
) -> DataFrame:
    """Replace the age column by its band, with one open band from ``open_age`` on."""
    band = S.top_code(S.age_band(F.col(age), width, limit), open_age)
    return df.withColumn("age_band", band).drop(age)


def with_breaks(df: DataFrame, breaks: Sequence[int], age: str = "age", limit: int | None = 125) -> DataFrame:
    """Replace the age column by its band between any rising ``breaks``, such as 0, 1, 5, 10, ..., the last one open up to ``limit``,
    with ``band_width``, the band's own number of years (NULL for the open one)."""
    banded = df.withColumn("age_band", S.band_of(age, breaks, limit)).drop(age)
    return banded.withColumn("band_width", S.band_width(F.col("age_band"), breaks))


def with_total(
    cells: DataFrame, value: str, by: Sequence[str] = CELL, geo: str = "geo_code", total: str = "BR"
) -> DataFrame:
    """Sum ``value`` per cell and append the same cells summed over all places, under code ``total``.

    Cells of an unknown place keep their NULL code and are part of the total. Rows of the source that carry the code
    ``total`` are its own totals and are left out, or each cell would count twice.
    """
    cells = cells.where(F.col(geo).isNull() | (F.col(geo) != total))
    others = [c for c in by if c != geo]
    keys = [F.col(c) for c in by]
    return (
        cells.groupingSets([keys, [F.col(c) for c in others]], *keys)
        .agg(F.sum(value).alias(value), F.grouping(geo).alias("_total"))
        .select(
            *[
                F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(c)).alias(c) if c == geo else c
                for c in by
            ],
            value,
        )
    )


def count_by(df: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Number of records per cell, as column ``n``."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def tabulate_events(
    records: DataFrame,
    by: Sequence[str] = ("year", "geo_code", "sex"),
    age: str = "age",
    width: int = 5,
    open_age: int = 85,
    total: str = "BR",
    breaks: Sequence[int] | None = None,
) -> DataFrame:
    """Count records per cell, for every place and for all places together.

    The records are read and aggregated once, with a partial count in every scan task; the totals
    are made from the resulting cells, so the row volume is never doubled for them. With ``breaks`` the bands lie
    between these, in place of bands of one ``width`` up to ``open_age``.
    """
    cell = [*by, "age_band"]
    return with_total(count_by(_banded(records, age, width, open_age, breaks), cell), "n", cell, total=total)


def _banded(records: DataFrame, age: str, width: int, open_age: int, breaks: Sequence[int] | None) -> DataFrame:
    if breaks is None:
        return with_age_band(records, age, width, open_age=open_age)
    return records.withColumn("age_band", S.band_of(age, breaks)).drop(age)


def with_levels(
    cells: DataFrame,
    value: str,
    levels: Sequence[str],
    by: Sequence[str] = ("year", "sex", "age_band"),
    top: tuple[str, str] = ("country", "BR"),
) -> DataFrame:
    """Sum ``value`` per cell on every level of a hierarchy of places: one row per level, place and the columns ``by``.

    ``levels`` are the columns of place codes, narrowest first; a code names one place of its level, whatever lies around it. All places together are the
    level and code ``top``. Columns ``level`` and ``geo_code`` take their place. All levels come out of one aggregation, as grouping sets over the
    cells, told apart by their grouping id: a NULL code is an unknown place of its level, never a sum. Rows that carry the
    code of ``top`` on a level are the source's own totals and are left out, or each cell would count twice.
    A record of which only a wider place is known is part of the unknown place on the levels below, and of the known ones above.
    """
    levels = list(levels)
    taken = {*levels, *by} & {"level", "geo_code", value}
    if not levels or taken - {*levels}:
        raise ValueError(f"levels must be given, and no key may be called {sorted(taken)}")
    for code in levels:
        cells = cells.where(F.col(code).isNull() | (F.col(code) != top[1]))
    keys = [F.col(c) for c in by]
    places = [F.col(c) for c in levels]
    sets = [*([*keys, place] for place in places), keys]
    # bits of the id stand for the columns in this order, first one highest: level k has all places but its own summed over
    summed = cells.groupingSets(sets, *keys, *places).agg(F.sum(value).alias("_value"), F.grouping_id().alias("_id"))
    level, geo = F.lit(top[0]), F.lit(top[1])
    for k in reversed(range(len(levels))):
        here = F.col("_id") == (1 << len(levels)) - 1 - (1 << (len(levels) - 1 - k))
        level, geo = F.when(here, F.lit(levels[k])).otherwise(level), F.when(here, places[k].cast("string")).otherwise(geo)
    return summed.select(*by, level.alias("level"), geo.alias("geo_code"), F.col("_value").alias(value))


def tabulate_hierarchy(
    records: DataFrame,
    levels: Sequence[str],
    by: Sequence[str] = ("year", "sex"),
    age: str = "age",
    width: int = 5,
    open_age: int = 85,
    breaks: Sequence[int] | None = None,
    top: tuple[str, str] = ("country", "BR"),
) -> DataFrame:
    """Count records per cell on every level of a hierarchy of places, such as municipality, state, region and country.

    The records are read and counted once, per cell of the narrowest level; all other levels are made from these cells.
    """
    cell = [*by, "age_band", *levels]
    cells = count_by(_banded(records, age, width, open_age, breaks), cell)
    return with_levels(cells, "n", levels, [*by, "age_band"], top)


def population_counts(
    raw: DataFrame,
    years: Sequence[int] | None = None,
    sexes: Mapping[str, str] | None = None,
    other_sex: str = "Feminino",
    total_label: str = "Total",
    total: str = "BR",
) -> DataFrame:
    """Population per cell with national totals; the source's own totals over ages, sexes or places are left out.

    The band comes from the number in its label, never from the position of the row.
    """
    return with_total(population_cells(raw, years, sexes, other_sex, total_label), "pop", CELL, total=total)


def population_hierarchy(
    raw: DataFrame,
    levels: Mapping[str, Column],
    years: Sequence[int] | None = None,
    sexes: Mapping[str, str] | None = None,
    other_sex: str = "Feminino",
    total_label: str = "Total",
    top: tuple[str, str] = ("country", "BR"),
) -> DataFrame:
    """Population per cell on every level of a hierarchy of places, ``levels`` being the expressions of their codes over ``geo_code``, narrowest first.

    The source's own totals are left out, as in ``population_counts``.
    """
    cells = population_cells(raw, years, sexes, other_sex, total_label).where(F.col("geo_code").isNull() | (F.col("geo_code") != top[1]))
    named = cells.select("year", "sex", "age_band", "pop", *[c.alias(name) for name, c in levels.items()])
    return with_levels(named, "pop", list(levels), top=top)


def population_cells(
    raw: DataFrame,
    years: Sequence[int] | None = None,
    sexes: Mapping[str, str] | None = None,
    other_sex: str = "Feminino",
    total_label: str = "Total",
) -> DataFrame:
    """Population per cell, without the source's totals over ages and sexes."""
    sexes = {"Male": "Masculino"} if sexes is None else sexes
    rows = raw if years is None else raw.where(F.col("year").isin(*years))
    return rows.where((F.col("age_label") != total_label) & (F.col("sex_label").isNull() | (F.col("sex_label") != total_label))).select(
        "year",
        F.col("geo_code").cast("string").alias("geo_code"),
        S.recode(F.col("sex_label"), sexes, other_sex).alias("sex"),
        S.band_from_label(F.col("age_label")).alias("age_band"),
        F.col("pop").cast("bigint").alias("pop"),
    )


def rebands(df: DataFrame, open_age: int = 80, value: str = "n", by: Sequence[str] = CELL) -> DataFrame:
    """Lower the open age band to ``open_age`` and add up what falls into it."""
    folded = df.withColumn("age_band", S.top_code(F.col("age_band"), open_age))
    return folded.groupBy(*by).agg(F.sum(value).alias(value))


def mean_over_years(
    df: DataFrame, years: Sequence[int], value: str = "n", by: Sequence[str] = ("geo_code", "sex", "age_band")
) -> DataFrame:
    """Mean yearly value of each place, sex and band over ``years``; a year without a record counts 0."""
    years = sorted(set(years))
    total = F.sum(F.col(value).cast("double"))
    return df.where(F.col("year").isin(years)).groupBy(*by).agg(S.yearly_mean(total, len(years)).alias(value))


def densify(
    df: DataFrame,
    values: Mapping[str, Column],
    bands: Sequence[int],
    by: Sequence[str] = ("year", "geo_code", "sex"),
    age: str = "age_band",
) -> DataFrame:
    """Sum ``values`` per group and band so that every group has every band of ``bands``.

    A band without data counts 0. Bands outside the grid are kept, an unknown (NULL) band too; a missing value makes
    the sum of its cell missing. Each row offers a zero for the grid bands and its own value for its band, and one
    aggregation with a map-side combine adds them up: the key list is neither collected, nor joined back, nor built by a second read.
    """
    grid = F.array(*[F.lit(b) for b in bands])
    spread = df.withColumn("_band", F.explode(F.array_union(grid, F.array(F.col(age)))))
    here = F.col("_band").eqNullSafe(F.col(age))
    return (
        spread.groupBy(*by, "_band")
        .agg(
            *[
                strict_total(F.when(here, v.cast("double")).otherwise(0.0)).alias(name)
                for name, v in values.items()
            ]
        )
        .withColumnRenamed("_band", age)
    )
