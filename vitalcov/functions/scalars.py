"""Scalar column expressions.

Null rules used throughout: a value that cannot be computed (bad text, division by zero,
logarithm of a non-positive number, NaN, infinity) is NULL, so that plain NULL logic decides
every later branch.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    """``col``, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def geometric_mean(a: Column, b: Column) -> Column:
    """Square root of the product, multiplied as doubles so that counts cannot overflow."""
    return F.sqrt(a.cast("double") * b.cast("double"))


def annual_log_growth(later: Column, earlier: Column, years: Column) -> Column:
    """Exponential growth rate per year between two sizes; NULL if either size is zero."""
    return ratio(F.ln(ratio(later, earlier)), years)


def number(col: Column, dtype: str = "double") -> Column:
    """Text to number; text that is no number is NULL."""
    return col.try_cast(dtype)


def municipality_code(mun_code: Column) -> Column:
    """Municipality code of six digits, whether it came with a check digit or without; anything else gives NULL."""
    code = F.trim(mun_code)
    return F.when(code.rlike(r"^\d{6,7}$"), F.substring(code, 1, 6))


def code_prefix(code: Column, end: int) -> Column:
    """Leading part of a code up to the ``end``-th character from its right (``end`` negative).

    ``end=-1`` keeps the whole code, ``end=-6`` keeps ``length - 5`` characters. A code that is
    too short gives the empty string.
    """
    return F.substring(code, F.lit(1), F.greatest(F.length(code) + F.lit(end + 1), F.lit(0)))


def state_code(mun_code: Column) -> Column:
    """State part of a municipality code with (7 digits) or without (6 digits) a check digit.

    White space around the code is ignored. Anything else is no such code and gives NULL: such a record belongs to an
    unknown place, and is still part of the national total.
    """
    code = F.trim(mun_code)
    return F.when(code.rlike(r"^\d{6,7}$"), F.substring(code, 1, 2))


def age_band(age: Column, width: int = 5, limit: int = 125) -> Column:
    """Lower bound of the half-open band ``[b, b + width)`` holding ``age``; NULL outside ``[0, limit)``."""
    return F.when((age >= 0) & (age < limit), (F.floor(age / width) * width).cast("int"))


def check_breaks(breaks: Iterable[int]) -> tuple[int, ...]:
    """The breaks as a tuple; they must rise and be at least one."""
    found = tuple(breaks)
    if not found or any(a >= b for a, b in zip(found, found[1:])):
        raise ValueError(f"breaks must rise: {found}")
    return found


def _search_text(name: str, breaks: tuple[int, ...]) -> str:
    """The last of ``breaks`` that is not above a column: a balanced tree of comparisons."""
    if len(breaks) == 1:
        return str(breaks[0])
    middle = len(breaks) // 2
    return f"CASE WHEN {name} < {breaks[middle]} THEN {_search_text(name, breaks[:middle])} ELSE {_search_text(name, breaks[middle:])} END"


def _search(value: Column, values: tuple[tuple[int, Column], ...]) -> Column:
    """The second of the last pair whose first is not above ``value``: a balanced tree of comparisons."""
    if len(values) == 1:
        return values[0][1]
    middle = len(values) // 2
    return F.when(value < values[middle][0], _search(value, values[:middle])).otherwise(_search(value, values[middle:]))


def band_of(age: Column | str, breaks: Iterable[int], limit: int | None = 125) -> Column:
    """Lower bound of the band holding ``age``: band i is ``[breaks[i], breaks[i + 1])``, the last one ends at ``limit``, or never.

    NULL for no age, one that is not a number, and one outside. One expression of binary search in the literal breaks: a row
    costs the logarithm of their number in comparisons, and no table of breaks is joined.
    """
    breaks = check_breaks(breaks)
    if limit is not None and limit <= breaks[-1]:
        raise ValueError(f"the last band must begin below {limit}")
    if isinstance(age, str):
        name = f"`{age.replace('`', '``')}`"
        below = "" if limit is None else f" AND {name} < {limit}"
        return F.expr(f"CAST(CASE WHEN {name} >= {breaks[0]} AND NOT isnan({name}){below} THEN {_search_text(name, breaks)} END AS INT)")
    inside = (age >= breaks[0]) & ~F.isnan(age.cast("double"))
    if limit is not None:
        inside = inside & (age < limit)
    return F.when(inside, _search(age, tuple((b, F.lit(b)) for b in breaks))).cast("int")


def on_breaks(band: Column | str, breaks: Iterable[int], values: Sequence[int | None]) -> Column:
    """The value that belongs to the lower bound ``band``, one of ``values`` for each of ``breaks``; NULL for what is no lower bound.

    Of a column given by name it is one parsed text; made node by node it costs several calls into the JVM for each break.
    """
    breaks = check_breaks(breaks)
    if isinstance(band, str):
        name = f"`{band.replace('`', '``')}`"
        cases = " ".join(f"WHEN {b} THEN {'NULL' if v is None else v}" for b, v in zip(breaks, values, strict=True))
        return F.expr(f"CAST(CASE {name} {cases} END AS INT)")
    pairs = tuple(zip(breaks, (F.lit(v).cast("int") for v in values), strict=True))
    return F.when(band.isin(*breaks), _search(band, pairs)).cast("int")


def band_width(band: Column, breaks: Iterable[int]) -> Column:
    """Years from the lower bound ``band`` to the next of ``breaks``; NULL for the open band and for what is no lower bound."""
    breaks = check_breaks(breaks)
    return on_breaks(band, breaks, [*(b - a for a, b in zip(breaks, breaks[1:])), None])


def top_code(band: Column, open_age: int) -> Column:
    """Fold every band from ``open_age`` on into the open band; NULL stays NULL."""
    return F.when(band >= open_age, F.lit(open_age)).otherwise(band).cast("int")


def onto_grid(band: Column | str, bands: Iterable[int]) -> Column:
    """The largest of ``bands`` that is not above ``band``; NULL below all of them."""
    return band_of(band, sorted(set(bands)), None)


def yearly_mean(total: Column, n_years: int) -> Column:
    """Mean per year of what ``n_years`` years sum up to. A year without a record is a year with 0, not a year less."""
    return total / F.lit(float(n_years))


def band_from_label(label: Column) -> Column:
    """First number in an age-band label, which is the lower bound of the band."""
    return number(F.regexp_extract(label, r"(\d+)", 1), "int")


def recode(col: Column, cases: Mapping[str, str], default: str) -> Column:
    """Replace listed values; everything else, NULL included, becomes ``default``."""
    out = F.lit(default)
    for old, new in cases.items():
        out = F.when(col == old, F.lit(new)).otherwise(out)
    return out


def lookup(col: Column, codebook: Mapping[str, str]) -> Column:
    """Label of a code out of a small literal codebook; unknown codes are NULL."""
    pairs = [F.lit(part) for pair in codebook.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def ratio_class(col: Column, year1: int, year2: int) -> Column:
    """Name the direction of a year2/year1 ratio; a missing ratio counts as equal."""
    value = finite(col)
    return (
        F.when(value < 1, F.lit(f"{year2} < {year1}"))
        .when(value > 1, F.lit(f"{year2} > {year1}"))
        .otherwise(F.lit(f"{year2} = {year1}"))
    )


def in_years(date: Column, years: Iterable[int]) -> Column:
    """Date falls in one of ``years``, written as ranges so that file readers can use it."""
    spans: list[list[int]] = []
    for year in sorted(set(years)):
        if spans and year == spans[-1][1] + 1:
            spans[-1][1] = year
        else:
            spans.append([year, year])
    test = F.lit(False)
    for i, (first, last) in enumerate(spans):
        span = (date >= F.lit(datetime.date(first, 1, 1))) & (date < F.lit(datetime.date(last + 1, 1, 1)))
        test = span if i == 0 else test | span
    return test
