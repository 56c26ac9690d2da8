"""What the physical plans must look like, and what they must not contain."""

import re

import pytest

import registry
from vitalcov.operators import ddm as D
from vitalcov.operators import redistribute as R
from vitalcov.operators import tabulate as T
from vitalcov.schemas import SCHEMAS
from vitalcov.sources import dims


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"Exchange (?:hash|range|Single)", text))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Empty tables on disk: the plans matter, not the rows."""
    root = tmp_path_factory.mktemp("tables")
    out = {}
    for name in ("deaths_raw", "counts", "spread_counts", "population", "ddm_input"):
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(str(root / name))
        out[name] = spark.read.schema(SCHEMAS[name]).parquet(str(root / name))
    return out


def test_records_are_read_once_and_counted_before_any_copy(files):
    text = plan(T.tabulate_events(T.slim_deaths(files["deaths_raw"], dims.SEX_LABELS)))
    assert text.count("FileScan") == 1
    # bottom-up: scan, partial count, shuffle; the rows for the national total are made from cells
    order = [m.group() for m in re.finditer(r"FileScan|partial_count|Exchange hash|Expand", text)][::-1]
    assert order[:3] == ["FileScan", "partial_count", "Exchange hash"]
    assert order.index("Expand") > order.index("Exchange hash")


def test_redistribution_needs_one_shuffle(files):
    text = plan(R.redistribute_unknown(files["counts"]))
    assert shuffles(text) == 1 and text.count("FileScan") == 1
    assert len(re.findall(r"Window \[", text)) == 3


def test_mass_check_needs_no_second_shuffle(files):
    text = plan(R.redistribution_mass(files["counts"]))
    assert shuffles(text) == 1 and text.count("FileScan") == 1


def test_method_input_and_all_methods_share_one_shuffle(spark, files):
    rows = D.ddm_input(files["spread_counts"], files["population"], 2000, 2010)
    text = plan(rows)
    assert shuffles(text) == 1 and "Join" not in text
    rows = D.with_e_open(D.method_points(rows), dims.e_open_table(spark, {"Feminino": 8.0}))
    cover = D.death_coverage(D.with_death_coverage(rows))
    text = plan(cover)
    assert shuffles(text) == 1
    assert text.count("FileScan") == 2
    assert len(re.findall(r"(?<!Broadcast)Sort \[", text)) == 1


def test_age_windows_merge(spark, files):
    rows = D.with_e_open(D.method_points(files["ddm_input"]), dims.e_open_table(spark, {"Feminino": 8.0}))
    assert len(re.findall(r"Window \[", plan(D.with_death_coverage(rows)))) <= 7


def test_flagship_reads_each_kind_of_record_once(spark, sf_dir):
    text = plan(registry.birth_coverage(spark, sf_dir))
    # lines stand in for deaths and for residents, orders for births and in both others
    assert len(re.findall(r"lineitem.parquet", text)) == 2
    assert len(re.findall(r"orders.parquet", text)) == 3
    assert text.count("GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)") == 3
    assert text.count("LessThan(o_orderdate,2001-01-01T00:00)") == 3


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_query_leaves_the_jvm_or_pairs_everything(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    if name == "ggb_fit_custom":  # a criterion of the caller's is Python by nature
        return
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition, ENSURE_REQ", "l_extendedprice"):
        if bad.startswith("Single") and name == "value_range":
            continue
        assert bad not in text, bad
    assert not re.search(r"hashpartitioning\((sex|sex_code)#\w+, \d+\)", text)
