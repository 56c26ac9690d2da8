import random
from collections import defaultdict

import pytest

from vitalcov.operators import redistribute as R

DDL = "year int, geo_code string, sex string, age_band int, n long"


def by_cell(df, value="n"):
    return {(r["year"], r["geo_code"], r["sex"], r["age_band"]): r[value] for r in df.collect()}


def brute(rows):
    """The three passes on plain dictionaries."""
    vals = {(y, g, s, a): float(n) for y, g, s, a, n in rows}

    def one_pass(vals, missing, group, base_known):
        known, unknown = defaultdict(float), defaultdict(float)
        for k, v in vals.items():
            (unknown if missing(k) else known)[group(k)] += v
        out = {}
        for k, v in vals.items():
            nm = 0.0 if missing(k) else v
            share = unknown[group(k)] * nm / known[group(k)] if known[group(k)] else 0.0
            out[k] = (nm if base_known else v) + share
        return out

    vals = one_pass(vals, lambda k: k[2] is None and k[3] is None, lambda k: k[:2], True)
    vals = one_pass(vals, lambda k: k[2] is None, lambda k: (k[0], k[1], k[3]), False)
    vals = one_pass(vals, lambda k: k[3] is None, lambda k: k[:3], False)
    return {k: v for k, v in vals.items() if k[2] is not None and k[3] is not None}


def table(year, geo, seed, full=True):
    rnd = random.Random(seed)
    sexes, ages = ["F", "M", None], [0, 5, 10, 85, None]
    cells = [(s, a) for s in sexes for a in ages]
    if not full:
        cells = rnd.sample(cells, 9)
    return [(year, geo, s, a, rnd.randint(1, 60)) for s, a in cells]


ALL_KNOWN = [
    (2000, "11", "F", 0, 10), (2000, "11", "F", 5, 20), (2000, "11", "M", 0, 30), (2000, "11", "M", 5, 5),
    (2000, "11", None, 0, 4), (2000, "11", None, 5, 6), (2000, "11", "F", None, 3), (2000, "11", "M", None, 2),
    (2000, "11", None, None, 8),
]
UNSPREADABLE = [(2000, "12", "F", 0, 10), (2000, "12", None, 5, 7)]


def test_equals_brute_force(spark):
    rows = [r for i in range(12) for r in table(2000 + i % 2, str(11 + i), i, full=i % 3 > 0)]
    got = by_cell(R.redistribute_unknown(spark.createDataFrame(rows, DDL)))
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_mass_is_kept_or_reported_as_lost(spark):
    df = spark.createDataFrame(ALL_KNOWN + UNSPREADABLE, DDL)
    mass = {r["geo_code"]: r for r in R.redistribution_mass(df).collect()}
    assert (mass["11"]["n_before"], mass["11"]["n_after"]) == (88.0, pytest.approx(88.0))
    assert (mass["12"]["n_before"], mass["12"]["n_after"], mass["12"]["n_lost"]) == (17.0, 10.0, 7.0)


def test_commutes_with_filters(spark):
    rows = [r for g in ("11", "12", "BR") for y in (2000, 2010) for r in table(y, g, f"{g}{y}")]
    df = spark.createDataFrame(rows, DDL)
    whole = by_cell(R.redistribute_unknown(df).where("geo_code = 'BR' AND year = 2010"))
    alone = by_cell(R.redistribute_unknown(df.where("geo_code = 'BR' AND year = 2010")))
    assert whole == pytest.approx(alone)


def test_identity_without_unknowns(spark):
    rows = [r for r in ALL_KNOWN if r[2] and r[3] is not None]
    assert by_cell(R.redistribute_unknown(spark.createDataFrame(rows, DDL))) == {r[:4]: float(r[4]) for r in rows}


def test_zero_counts_stay_zero(spark):
    rows = [(2000, "11", "F", 0, 0), (2000, "11", "M", 0, 0), (2000, "11", "F", 5, 3), (2000, "11", None, None, 3)]
    got = by_cell(R.redistribute_unknown(spark.createDataFrame(rows, DDL)))
    assert got == {(2000, "11", "F", 0): 0.0, (2000, "11", "M", 0): 0.0, (2000, "11", "F", 5): 6.0}


def test_order_and_partitions_do_not_matter(spark):
    rows = [r for i in range(6) for r in table(2000, str(11 + i), i)]
    one = by_cell(R.redistribute_unknown(spark.createDataFrame(rows, DDL).coalesce(1)))
    many = by_cell(R.redistribute_unknown(spark.createDataFrame(rows[::-1], DDL).repartition(11)))
    assert one == pytest.approx(many)


def test_flags(spark):
    flags = R.flag_missing(spark.createDataFrame(ALL_KNOWN, DDL)).collect()
    assert sum(r["age_missing"] for r in flags) == 3
    assert sum(r["sex_missing"] for r in flags) == 3
    assert sum(r["both_missing"] for r in flags) == 1
