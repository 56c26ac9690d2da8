"""Every registered query against its SQL twin."""

import duckdb
import pytest

import __spark_entry__ as entry
import oracle
import registry
from vitalcov.sources import order_tables

TABLES = ("region", "nation", "customer", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield con
    con.close()


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_a_twin():
    assert registry.QUERIES.keys() == oracle.ORACLES.keys()
    assert entry.queries().keys() >= registry.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    have = [c[0] for c in cursor.description]
    assert sorted(have) == cols
    want = [tuple(row[have.index(c)] for c in cols) for row in cursor.fetchall()]
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert len(got) > 0
    assert ordered(got) == ordered(want)


def test_entry_returns_estimates(spark):
    out = entry.entry(spark)
    assert out.columns == ["geo_code", "sex", "year", "cbr", "birth_rate_implied", "coverage_b", "completeness"]
    assert out.count() == 24


def test_all_ages_rows_are_there_to_be_dropped(spark, sf_dir):
    raw = order_tables.raw_population(spark, sf_dir, all_ages=True)
    assert raw.where("age_label = 'Total'").count() > 0
