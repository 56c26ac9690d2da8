"""Death-distribution methods: how complete the registration of deaths is.

For each place and sex and ages x = 0, 5, ..., A (open), with counts P1 and P2 taken t years apart
and D the mean yearly deaths:

    N(x)  = sqrt(P1[x-5] P2[x]) / 5                    yearly arrivals at age x
    T(x+) = sqrt(P1(x+) P2(x+))                        exposure at x and over
    growth balance   N(x)/T(x+) - r(x+) = k + D(x+)/T(x+) / c
    extinct cohorts  N*(x) = what the deaths at x and over say N(x) must have been; c = N*/N

Bands may have other widths, and different ones (0, 1, 5, 10, ...), which the grid tells; every group has all its ages. N(x) is then the geometric mean of the two densities beside x, weighted by how near the middle of their
bands is, and carried to the middle of the period by their growth (unweighted beside a band without a growth rate); sums over growth take each band by its width.

All of it is window arithmetic over the age rows of one (place, sex), so the whole chain runs in
one exchange; every column a method adds holds the same value on all rows of its group.
References: Hill (1987); Bennett and Horiuchi (1981); Hill, You and Choi (2009).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from vitalcov.functions import scalars as S
from vitalcov.functions.windows import BY, below_age, by_age, from_age_on, strict_sum, whole_group
from vitalcov.operators.tabulate import densify

BANDS = tuple(range(0, 85, 5))
METHODS = ("ggb", "seg", "ggbseg", "mean_3", "mean_2")
#: Largest table by sex that becomes literals.
MOST_LEVELS = 1000
#: By which power of the relative coverage N*/N changes when this count is the one that is rescaled.
RESCALED = {"first": 0.5, "both": 0.0, "second": -0.5}
#: Most ages that a place and sex may have in a search by a caller's criterion.
MOST_AGES = 1000
#: Score of a candidate run, lower is better: (ages, x, y, slope, intercept) -> number; y and x are ``ggb_left`` and ``ggb_right``.
Criterion = Callable[[np.ndarray, np.ndarray, np.ndarray, float, float], float]


def check_grid(bands: Sequence[int]) -> tuple[int, ...]:
    """The grid of lower bounds: rising, from 0 on, three bands at least."""
    grid = S.check_breaks(bands)
    if grid[0] != 0 or len(grid) < 3:
        raise ValueError(f"a grid of ages begins at 0 and has three bands at least: {grid}")
    return grid


def _widths(bands: Sequence[int]) -> list[int]:
    return [b - a for a, b in zip(bands, bands[1:])]


def common_width(bands: Sequence[int]) -> int:
    """The commonest width of a grid, the smaller of equally common ones."""
    widths = _widths(bands)
    return min(set(widths), key=lambda w: (-widths.count(w), w))


@dataclass(frozen=True)
class FitSearch:
    """Which runs of consecutive ages the growth-balance line may be fitted to.

    ``criterion`` is ``"r2"`` (highest squared correlation), ``"rms"`` (lowest residual mean
    square), or a function of the caller's, see ``fit_search``. Equal candidates are decided by the lower start, then the lower end.
    """

    min_age: int = 15
    max_age: int = 75
    min_ages: int = 8
    criterion: str | Criterion = "r2"

    def __post_init__(self) -> None:
        if not callable(self.criterion) and self.criterion not in ("r2", "rms"):
            raise ValueError(f"unknown criterion {self.criterion!r}")

    def reaches(self, bands: Sequence[int]) -> list[int]:
        """The different lengths, in years from first to last age, of the runs that a grid allows."""
        ages = [b for b in check_grid(bands) if self.min_age <= b <= self.max_age]
        if len(ages) < self.min_ages:
            raise ValueError(f"{len(ages)} ages of the grid lie between {self.min_age} and {self.max_age}, and a fit needs {self.min_ages}: change min_ages, min_age or max_age")
        return sorted({hi - lo for i, lo in enumerate(ages) for hi in ages[i + self.min_ages - 1 :]})


@dataclass(frozen=True)
class Settings:
    """The choices of the whole estimation.

    ``seg_ages`` and ``ggbseg_ages`` are the ages the two methods are summarised over, ``None`` for those that the growth-balance
    fit chose; ``summary`` is ``"mean"`` or ``"median"``; ``bands`` the lower bounds of the ages, of any widths; ``rescale`` which count the
    combined method corrects: the ``"first"``, the ``"second"`` or ``"both"`` by half; ``shift`` (in bands of the commonest width) and ``switch_age`` how cohorts are paired.
    """

    search: FitSearch = FitSearch()
    seg_ages: tuple[int, int] | None = (15, 75)
    ggbseg_ages: tuple[int, int] | None = None
    summary: str = "mean"
    bands: tuple[int, ...] = BANDS
    shift: int = 2
    switch_age: int = 75
    rescale: str = "first"

    def __post_init__(self) -> None:
        check_grid(self.bands)
        if self.rescale not in RESCALED:
            raise ValueError(f"unknown count to rescale {self.rescale!r}")
        if self.summary not in ("mean", "median"):
            raise ValueError(f"unknown summary {self.summary!r}")


def deaths_population(
    deaths: DataFrame,
    pop: DataFrame,
    keys: Sequence[str] = ("year", "geo_code", "sex", "age_band"),
) -> DataFrame:
    """Population cells with their deaths; a cell without a death record has 0 deaths.

    Deaths outside every population cell (unknown place, say) have no partner and drop out;
    ``unmatched_keys`` lists them.
    """
    events = deaths.select(*keys, F.col("n").cast("double").alias("deaths"))
    return pop.select(*keys, "pop").join(events, list(keys), "left").fillna(0.0, ["deaths"])


def ddm_input(
    deaths: DataFrame,
    pop: DataFrame,
    year1: int,
    year2: int,
    bands: Sequence[int] = BANDS,
    by: Sequence[str] = BY,
) -> DataFrame:
    """One row per place, sex and band: both counts and the mean yearly deaths of the two years.

    Every band is folded onto the grid, into the largest grid band not above it, so that all groups have the same
    ages and neighbouring rows are neighbouring ages. Bands missing from the data come out as 0, a missing value stays missing.
    Deaths count only in cells that have a population, as in ``deaths_population``, and a place
    without any population gives no rows.

    Both tables are stacked and partitioned once by ``by``. Pairing deaths with population, placing
    the years side by side, averaging and filling gaps are then one aggregation in that partition,
    and the age windows of the methods that follow need no further exchange.
    """
    band = S.onto_grid("age_band", bands).alias("age_band")
    pop_rows = pop.select("year", *by, band, F.lit(True).alias("_people"), F.col("pop").cast("double").alias("_value"))
    death_rows = deaths.select("year", *by, band, F.lit(False).alias("_people"), F.col("n").cast("double").alias("_value"))
    stacked = pop_rows.unionByName(death_rows).where(F.col("year").isin(year1, year2) & F.col("age_band").isNotNull()).repartition(*by)
    sums = {}
    for i, year in ((1, year1), (2, year2)):
        here = F.col("year") == year
        sums[f"pop{i}"] = F.when(here & F.col("_people"), F.col("_value")).otherwise(0.0)
        sums[f"_deaths{i}"] = F.when(here & ~F.col("_people"), F.col("_value")).otherwise(0.0)
        sums[f"_cells{i}"] = F.when(here & F.col("_people"), 1.0).otherwise(0.0)
    dense = densify(stacked, sums, bands, by)
    counted = [F.when(F.col(f"_cells{i}") > 0, F.col(f"_deaths{i}")).otherwise(0.0) for i in (1, 2)]
    populated = F.sum(F.col("_cells1") + F.col("_cells2")).over(whole_group(by))
    return (
        dense.withColumn("_populated", populated)
        .where(F.col("_populated") > 0)
        .select(
            *by,
            "age_band",
            F.lit(year1).alias("year1"),
            F.lit(year2).alias("year2"),
            S.finite(F.col("pop1")).alias("pop1"),
            S.finite(F.col("pop2")).alias("pop2"),
            S.finite(S.yearly_mean(counted[0] + counted[1], 2)).alias("deaths"),
        )
    )


def _years_between() -> Column:
    return F.col("year2") - F.col("year1")


def _grid_widths(bands: Sequence[int]) -> tuple[Column, Column]:
    """Width of the band of a row and of the one below it; the open band is as wide as the one below."""
    grid = check_grid(bands)
    widths = _widths(grid)
    own_width, before = (S.on_breaks("age_band", grid, w) for w in ([*widths, widths[-1]], [None, *widths]))
    return own_width.cast("double"), before.cast("double")


def method_points(df: DataFrame, by: Sequence[str] = BY, bands: Sequence[int] = BANDS) -> DataFrame:
    """Add what all methods start from, in one window pass over the ages of a group.

    - ``w``: the band's years by the grid ``bands``; for the open band those of the band below, for an age off the grid NULL;
    - ``rx``: growth rate of the population at each age and over;
    - ``arrivals`` N(x), NULL at the first age and where a zero cell leaves nothing to measure;
    - ``exposure`` T(x+), and the growth-balance points ``ggb_left``, ``ggb_right``;
    - ``r``: growth rate of the band, NULL beside a zero cell; ``g_below`` its sum over all younger
      bands, each by its width, ``w_below`` the width of those that have a rate; ``is_open`` marks the oldest band.
    """
    rate = S.annual_log_growth(F.col("pop2"), F.col("pop1"), _years_between())
    ages, below, over = by_age(by), below_age(by), from_age_on(by)
    width, width_before = _grid_widths(bands)
    windowed = df.withColumns({"r": rate, "w": width, "_w_before": width_before}).withColumns(
        {
            **{f"_{c}": strict_sum(F.col(c), over) for c in ("pop1", "pop2", "deaths")},
            "_before": F.lag("pop1").over(ages),
            "_r_before": F.lag("r").over(ages),
            "g_below": F.coalesce(F.sum(F.col("r") * F.col("w")).over(below), F.lit(0.0)),
            "w_below": F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("w"))).over(below), F.lit(0.0)),
            "is_open": F.lead("age_band").over(ages).isNull(),
        }
    )
    reached = S.ratio(S.geometric_mean(F.col("_before"), F.col("pop2")), S.geometric_mean(F.col("_w_before"), F.col("w")))
    # how far the middle of the band below is nearer to x than that of the band above; 0 for bands of one width
    nearer = F.col("w") / (F.col("w") + F.col("_w_before")) - 0.5
    densities = S.ratio(F.col("_before") * F.col("w"), F.col("pop2") * F.col("_w_before"))
    growth = F.exp(_years_between() * (F.col("r") + F.col("_r_before")) / 2)
    plain = (F.col("w") == F.col("_w_before")) | F.col("r").isNull() | F.col("_r_before").isNull()
    arrivals = reached if len(set(_widths(bands))) == 1 else F.when(plain, reached).otherwise(reached * F.pow(densities * growth, nearer))
    return (
        windowed.withColumns(
            {
                "rx": S.annual_log_growth(F.col("_pop2"), F.col("_pop1"), _years_between()),
                "arrivals": F.when(reached > 0, arrivals),
                "exposure": S.geometric_mean(F.col("_pop1"), F.col("_pop2")),
            }
        )
        .withColumns(
            {
                "ggb_left": S.ratio(F.col("arrivals"), F.col("exposure")) - F.col("rx"),
                "ggb_right": S.ratio(F.col("_deaths"), F.col("exposure")),
            }
        )
        .drop("_pop1", "_pop2", "_deaths", "_before", "_w_before", "_r_before")
    )


def ggb(df: DataFrame, search: FitSearch = FitSearch(), by: Sequence[str] = BY, bands: Sequence[int] = BANDS) -> DataFrame:
    """Add growth-balance coverage ``ggb``, the relative coverage of the first count ``delta``, and
    the chosen fit ages ``fit_lo``, ``fit_hi``. Needs the columns of ``method_points``.

    The run of ages that starts at a row and reaches so many years on is the window frame ``[age, age + reach]``, so
    the candidate fits are columns of their first row and no candidate list has to be joined.
    Points that are NULL take no part, and a run needs ``min_ages`` usable points. With a criterion of the caller's the
    search is ``fit_search``.
    """
    if callable(search.criterion):
        return fit_search(df, search, by)
    reaches = search.reaches(bands)
    group = ", ".join(f"`{c.replace('`', '``')}`" for c in by)
    frame = f"PARTITION BY {group} ORDER BY age_band RANGE BETWEEN CURRENT ROW AND"
    # given as text, parsed at once: made column by column they cost some hundred calls into the JVM
    moments = {
        f"_{name}_{reach}": f"regr_{name}(ggb_left, ggb_right) OVER ({frame} {reach} FOLLOWING) AS _{name}_{reach}"
        for reach in reaches
        for name in ("count", "avgx", "avgy", "sxx", "syy", "sxy")
    }
    best = F.min(F.expr(f"array_min(array({', '.join(_fit(reach, search, bands) for reach in reaches)}))")).over(whole_group(by))
    return (
        df.selectExpr("*", *moments.values())
        .withColumn("_fit", best)
        .withColumns(
            {
                "fit_lo": F.col("_fit.lo"),
                "fit_hi": F.col("_fit.hi"),
                "ggb": F.col("_fit.ggb"),
                "delta": S.finite(F.col("_fit.delta")),
            }
        )
        .drop("_fit", *moments)
    )


def r2_criterion(ages: np.ndarray, x: np.ndarray, y: np.ndarray, slope: float, intercept: float) -> float:
    """Less the squared correlation: what ``"r2"`` means."""
    return -float(np.corrcoef(x, y)[0, 1]) ** 2


def rms_criterion(ages: np.ndarray, x: np.ndarray, y: np.ndarray, slope: float, intercept: float) -> float:
    """Residual mean square: what ``"rms"`` means."""
    return float(np.var(y - slope * x, ddof=1))


def best_run(ages: np.ndarray, x: np.ndarray, y: np.ndarray, years: int, search: FitSearch) -> tuple[int, int, float, float | None] | None:
    """The run of ages with the lowest score, as (first, last, coverage, delta), or none.

    All runs between the search's ages that begin and end at an age of the group are tried; points with a NaN take no part, but a
    run needs ``min_ages`` others, and a slope. A score that is NaN is no score.
    """
    inside = np.flatnonzero((ages >= search.min_age) & (ages <= search.max_age))
    usable = np.isfinite(x) & np.isfinite(y)
    best = None
    for i, first in enumerate(inside.tolist()):
        for last in inside[i + search.min_ages - 1 :].tolist():
            here = np.arange(first, last + 1)[usable[first : last + 1]]
            if len(here) < search.min_ages:
                continue
            sx, sy = np.std(x[here]), np.std(y[here])
            if not sx > 0 or not sy > 0 or not (sx * sy) ** 2 > 0:
                continue
            slope = float(sy / sx)
            intercept = float(y[here].mean() - slope * x[here].mean())
            score = float(search.criterion(ages[here], x[here], y[here], slope, intercept))
            found = (round(score, 12), int(ages[first]), int(ages[last]), 1 / slope, intercept)
            if score == score and (best is None or found < best):
                best = found
    if best is None:
        return None
    delta = float(np.exp(np.clip(best[4] * years, -700, 700)))
    return best[1], best[2], best[3], delta if abs(best[4] * years) < 700 else None


def fit_search(df: DataFrame, search: FitSearch, by: Sequence[str] = BY) -> DataFrame:
    """The columns of ``ggb`` by a criterion of the caller's, a function of numpy arrays that scores one candidate run.

    One place and sex is one call of a grouped map on Arrow tables; such a group has one row an age, which is checked against ``MOST_AGES``, so
    a task holds one small group at a time. The rows come back with four more columns. It takes the partitioning by ``by`` as it is,
    but what follows must partition anew. The named criteria stay in the window form.
    """
    new = [StructField("fit_lo", IntegerType()), StructField("fit_hi", IntegerType()), StructField("ggb", DoubleType()), StructField("delta", DoubleType())]

    def fitted(group: pa.Table) -> pa.Table:
        if group.num_rows > MOST_AGES:
            raise ValueError(f"a place and sex with more than {MOST_AGES} ages")
        group = group.sort_by("age_band")
        ages, x, y = (group.column(c).to_numpy().astype(float) for c in ("age_band", "ggb_right", "ggb_left"))
        run = best_run(ages, x, y, group.column("year2")[0].as_py() - group.column("year1")[0].as_py(), search)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
        for k, field in enumerate(new):
            group = group.append_column(field.name, pa.array([run[k] if run else None] * group.num_rows, kinds[k]))
        return group

    return df.groupBy(*by).applyInArrow(fitted, StructType([*df.schema.fields, *new]))


def _fit(reach: int, search: FitSearch, bands: Sequence[int]) -> str:
    """The line through the run of ages starting here, as ``(score, lo, hi, ggb, delta)``; the lowest
    struct is the best fit. NULL if the run is not allowed or has no line.

    The slope is the ratio of the two standard deviations, so coverage is its inverse.
    """
    n, x, y, sxx, syy, sxy = (f"_{m}_{reach}" for m in ("count", "avgx", "avgy", "sxx", "syy", "sxy"))
    # a run begins and ends at ages of the grid
    starts = [b for b in bands if b >= search.min_age and b + reach <= search.max_age and b + reach in bands] or ["NULL"]
    slope = f"sqrt({syy} / {sxx})"
    score = {
        "r2": f"-{sxy} * {sxy} / ({sxx} * {syy})",
        "rms": f"({syy} - 2 * {slope} * {sxy} + {slope} * {slope} * {sxx}) / ({n} - 1)",
    }[search.criterion]
    return f"""CASE WHEN age_band IN ({', '.join(map(str, starts))})
                  AND {n} >= {search.min_ages} AND {sxx} > 0 AND {syy} > 0 AND {sxx} * {syy} > 0
            THEN named_struct('score', round({score}, 12), 'lo', age_band, 'hi', age_band + {reach},
                              'ggb', sqrt({sxx} / {syy}),
                              'delta', exp(({y} - {slope} * {x}) * (year2 - year1))) END"""


def _extinct_generations(
    df: DataFrame, name: str, delta: Column | None, fits: Column, summary: str, by: Sequence[str], rescale: str = "first"
) -> DataFrame:
    """Add column ``name``, a summary of N*(x)/N(x) over the ages where ``fits`` holds.

    The recursion N*(x) = N*(x+w) exp(w r) + D exp(w r / 2) is solved in closed form: with
    G(x) the sum of w r below x, N*(x) is the sum of D(y) exp(G(y) - G(x) + w r(y) / 2) over
    the ages y from x on. The exponents are subtracted before exp is taken, because with extreme
    growth each of them alone would overflow. The summed list has one entry per older band.
    Dividing the first count by ``delta`` adds ln(delta)/t to every growth rate and divides every
    N(x) by sqrt(delta); multiplying the second one adds the same and multiplies N(x) by it; sharing ``delta`` between both leaves N(x) as it is.
    So a rescaled population needs no new window of its own.
    """
    # median takes no ordered window, so it gets one of its own
    summaries = {"mean": (F.avg, whole_group(by)), "median": (F.median, Window.partitionBy(*by))}
    summarise, group = summaries[summary]
    shift = F.lit(0.0) if delta is None else S.ratio(F.ln(delta), _years_between())
    scale = F.lit(1.0) if delta is None else F.pow(delta, F.lit(RESCALED[rescale]))
    # no rate, no growth: the shift goes to the bands that have a rate
    r = F.when(F.col("r").isNotNull(), F.col("r") + shift).otherwise(0.0)
    g = F.col("g_below") + shift * F.col("w_below")
    open_growth = r * F.col("e_open")
    term = F.struct(
        F.when(F.col("is_open"), F.col("deaths") * (F.exp(open_growth) - open_growth * open_growth / 6))
        .otherwise(F.col("deaths"))
        .alias("d"),
        F.when(F.col("is_open"), g).otherwise(g + r * F.col("w") / 2).alias("h"),
    )
    terms = F.collect_list(term).over(from_age_on(by))
    built = F.aggregate(terms, F.lit(0.0), lambda total, t: total + t["d"] * F.exp(t["h"] - g))
    ratio = S.finite(S.ratio(built * scale, F.col("arrivals")))
    return (
        df.withColumn("_ratio", F.when(fits, ratio))
        .withColumn(name, summarise("_ratio").over(group))
        .drop("_ratio")
    )


def _fit_ages(fit_ages: tuple[int, int] | None) -> Column:
    """Test for the ages to summarise over: a fixed span, or the one chosen by ``ggb``."""
    lo, hi = (F.col("fit_lo"), F.col("fit_hi")) if fit_ages is None else map(F.lit, fit_ages)
    return F.col("age_band").between(lo, hi)


def seg(
    df: DataFrame,
    fit_ages: tuple[int, int] | None = (15, 75),
    summary: str = "mean",
    by: Sequence[str] = BY,
) -> DataFrame:
    """Add extinct-generations coverage ``seg``, the ``"mean"`` or ``"median"`` over the fit ages.

    Needs the columns of ``method_points`` and ``e_open``, the life expectancy at the start of the
    open band; with ``fit_ages=None`` also the fit ages of ``ggb``.
    """
    return _extinct_generations(df, "seg", None, _fit_ages(fit_ages), summary, by)


def ggb_seg(
    df: DataFrame,
    fit_ages: tuple[int, int] | None = None,
    summary: str = "mean",
    by: Sequence[str] = BY,
    rescale: str = "first",
) -> DataFrame:
    """Add the combined coverage ``ggbseg``: extinct generations after the ``"first"`` count, the ``"second"`` or ``"both"`` are rescaled
    by the ``delta`` of ``ggb``. Needs what ``seg`` needs, and the columns of ``ggb``.

    Coverage is then relative to the count that is left as it is, or to the mean of both."""
    return _extinct_generations(df, "ggbseg", F.col("delta"), _fit_ages(fit_ages), summary, by, rescale)


def _small(table: DataFrame, cols: Sequence[str]) -> list:
    """All rows of a table that must have at most ``MOST_LEVELS``, without those of an unknown sex."""
    rows = table.where(F.col("sex").isNotNull()).select(*cols).limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"a table per sex of more than {MOST_LEVELS} rows")
    return rows


def attach_e_open(df: DataFrame, table: DataFrame | Mapping[str, float]) -> DataFrame:
    """Add ``e_open`` out of a mapping or table by ``sex``, or a table by ``geo_code`` and ``sex``.

    Values by sex become literals, with no join: a join on two or three values would undo the partitioning by place. A table by
    place is joined on the key that the rows are partitioned by. A key that stands twice is refused.
    """
    if isinstance(table, DataFrame) and "geo_code" in table.columns:
        once = table.groupBy(*BY).agg(F.count("*").alias("_rows"), F.max("e_open").alias("e_open"))
        checked = F.when(F.col("_rows") == 1, F.col("e_open")).otherwise(F.raise_error(F.lit("e_open: a place and sex stands twice")))
        return df.join(once.select(*BY, checked.alias("e_open")), list(BY), "left")
    if isinstance(table, DataFrame):
        rows = _small(table, ["sex", "e_open"])
        if len({r["sex"] for r in rows}) < len(rows):
            raise ValueError("e_open: a sex stands twice")
        table = {r["sex"]: r["e_open"] for r in rows}
    value = F.lit(None).cast("double")
    for sex, e_open in table.items():
        value = F.when(F.col("sex") == sex, F.lit(e_open).cast("double")).otherwise(value)
    return df.withColumn("e_open", value)


def with_death_ratio(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add ``death_ratio``, growth-adjusted deaths at ages 10-39 over those at 40-59, the way into a model life table.

    Needs the columns of ``method_points``. Bands belong to the span their first age is in; 10, 40 and 60 should begin one.
    """
    r = F.coalesce(F.col("r"), F.lit(0.0))
    adjusted = F.col("deaths") * F.exp(F.col("g_below") + F.col("w") * r / 2)

    def deaths_at(first: int, last: int) -> Column:
        return F.sum(F.when(F.col("age_band").between(first, last), adjusted)).over(whole_group(by))

    return df.withColumn("death_ratio", S.ratio(deaths_at(10, 39), deaths_at(40, 59)))


def e_open_from_place_levels(df: DataFrame, levels: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add ``e_open`` read off the levels ``(*by, ratio, e_open)`` of each place and sex, a table of any size.

    Needs the columns of ``method_points``. Interpolates as ``e_open_from_levels`` does, without a range join: levels and the one
    ``death_ratio`` of a group are stacked and sorted by ratio, and the place of a group sees the last level before it and the first one behind it
    through two windows. The value is spread to the group's ages by the key they are partitioned by. A level without a ratio is no level; a ratio that
    stands twice for a place and sex is refused; a group without levels or death ratio gets NULL.
    """
    rated = with_death_ratio(df, by)
    asked = rated.groupBy(*by).agg(F.max("death_ratio").alias("ratio")).where(F.col("ratio").isNotNull())
    level = F.struct(F.col("ratio").alias("x"), F.col("e_open").cast("double").alias("e"))
    known = levels.where(F.col("ratio").isNotNull()).withColumn("ratio", F.col("ratio").cast("double"))
    stacked = known.select(*by, "ratio", level.alias("_level")).unionByName(asked.select(*by, "ratio", F.lit(None).cast("struct<x:double,e:double>").alias("_level")))
    # at equal ratios the levels come first, so that a group on a level sees it as the one at hand
    order = Window.partitionBy(*by).orderBy("ratio", F.col("_level").isNull())
    twice = F.col("_level").isNotNull() & (F.lag(F.col("_level.x")).over(order) == F.col("ratio"))
    low = F.last("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the check stands among the columns of every row, so that no filter can pass it by
    placed = stacked.select(*by, "ratio", F.col("_level").isNull().alias("_asked"), low.alias("_low"), high.alias("_high"), twice.alias("_twice"))
    slope = S.ratio(F.col("_high.e") - F.col("_low.e"), F.col("_high.x") - F.col("_low.x"))
    value = F.when(F.col("_low").isNull(), F.col("_high.e")).otherwise(F.coalesce(F.col("_low.e") + slope * (F.col("ratio") - F.col("_low.x")), F.col("_low.e")))
    read = placed.groupBy(*by).agg(F.max("_twice").alias("_twice"), F.max(F.when(F.col("_asked"), value)).alias("_value"))
    checked = F.when(F.col("_twice"), F.raise_error(F.lit("e_open levels: a ratio stands twice for a place and sex"))).otherwise(F.col("_value"))
    return rated.join(read.select(*by, checked.alias("e_open")), list(by), "left")


def e_open_from_levels(df: DataFrame, levels: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add ``e_open`` read off a model life table, column ``death_ratio`` being the way in.

    Needs the columns of ``method_points``. ``levels`` holds
    ``(sex, ratio, e_open)``; between two levels the value is interpolated linearly, outside them
    the nearest level is used. The levels, at most ``MOST_LEVELS``, become literals: no join, no exchange.
    A ratio that stands twice for a sex is refused.
    """
    tables: dict[str, dict[float, float]] = {}
    for row in _small(levels, ["sex", "ratio", "e_open"]):
        if row["ratio"] in tables.setdefault(row["sex"], {}):
            raise ValueError("e_open levels: a ratio stands twice")
        tables[row["sex"]][row["ratio"]] = row["e_open"]
    rated = with_death_ratio(df, by)
    x, value = F.col("death_ratio"), F.lit(None).cast("double")
    for sex, steps in tables.items():
        known = sorted((ratio, e) for ratio, e in steps.items() if ratio is not None)
        if known:
            value = F.when((F.col("sex") == sex) & x.isNotNull(), _interpolated(x, known)).otherwise(value)
    return rated.withColumn("e_open", value)


def _interpolated(x: Column, known: Sequence[tuple[float, float]]) -> Column:
    """Value at ``x`` of the line through the ascending points ``known``, level beyond its ends."""
    point = "struct<x:double,e:double>"
    points = F.array(*[F.struct(F.lit(float(r)).alias("x"), F.lit(e).cast("double").alias("e")) for r, e in known]).cast(f"array<{point}>")
    place = F.size(F.filter(points, lambda p: p["x"] < x))
    low, high = F.get(points, place - 1), F.get(points, place)
    slope = S.ratio(high["e"] - low["e"], high["x"] - low["x"])
    return F.coalesce(low["e"] + slope * (x - low["x"]), high["e"], low["e"])


def combine_methods(df: DataFrame) -> DataFrame:
    """Add ``mean_3`` over the three methods and ``mean_2`` over the two growth-balance ones."""
    g, s, gs = F.col("ggb"), F.col("seg"), F.col("ggbseg")
    return df.withColumns({"mean_3": (g + s + gs) / 3, "mean_2": (g + gs) / 2})


def choose_coverage(df: DataFrame) -> DataFrame:
    """Add ``coverage``: the first of the candidates below 1, in a fixed order of preference.

    ``mean_2``, else ``ggbseg``, else ``ggb``, else ``seg`` whatever its value. The later tests
    require the earlier candidates to be above 1, so a value of exactly 1, or a missing one, leads
    to ``seg``.
    """
    m2, gs, g = (S.finite(F.col(c)) for c in ("mean_2", "ggbseg", "ggb"))
    chosen = (
        F.when(m2 < 1, m2)
        .when((m2 > 1) & (gs < 1), gs)
        .when((m2 > 1) & (gs > 1) & (g < 1), g)
        .otherwise(S.finite(F.col("seg")))
    )
    return df.withColumn("coverage", chosen)


def with_e_open(points: DataFrame, e_open: DataFrame | Mapping[str, float]) -> DataFrame:
    """Add ``e_open`` from values, or from model life-table levels if the table has a ``ratio``: per place if it has a ``geo_code`` too."""
    levels = isinstance(e_open, DataFrame) and "ratio" in e_open.columns
    if levels and "geo_code" in e_open.columns:
        return e_open_from_place_levels(points, e_open)
    return e_open_from_levels(points, e_open) if levels else attach_e_open(points, e_open)


def with_death_coverage(
    points: DataFrame,
    search: FitSearch = FitSearch(),
    seg_ages: tuple[int, int] | None = (15, 75),
    ggbseg_ages: tuple[int, int] | None = None,
    summary: str = "mean",
    by: Sequence[str] = BY,
    bands: Sequence[int] = BANDS,
    rescale: str = "first",
) -> DataFrame:
    """Add every method, the means and the chosen ``coverage`` to the age rows.

    Needs the columns of ``method_points`` and ``e_open``; of the former only ``rx`` is kept.
    """
    plain = seg(ggb(points, search, by, bands), seg_ages, summary, by)
    both = ggb_seg(plain, ggbseg_ages, summary, by, rescale)
    scratch = ("arrivals", "exposure", "ggb_left", "ggb_right", "r", "w", "g_below", "w_below", "is_open")
    return choose_coverage(combine_methods(both)).drop(*scratch)


def death_coverage(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The method columns of ``with_death_coverage``, one row per place and sex."""
    cols = ("fit_lo", "fit_hi", "delta", *METHODS, "coverage")
    return df.groupBy(*by).agg(*[F.max(c).alias(c) for c in cols])


def coverage_long(df: DataFrame, methods: Sequence[str] = METHODS, by: Sequence[str] = BY) -> DataFrame:
    """One row per place, sex and method, with the coverage the method gives."""
    return df.unpivot(list(by), list(methods), "method", "coverage")
