"""Order tables in the role of registry files.

The test tables hold no vital records, so order lines stand in for deaths and residents, orders
for births, and regions for states. The views have the schemas of real registry files and go
through the same operators.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcov.functions.scalars import band_of, band_width, in_years

# the years the order tables hold
ALL_YEARS = tuple(range(1995, 2002))

# the columns in use, declared so that opening a table needs no job to look at its files
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
}


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _placed_orders(spark: SparkSession, sf_dir: str, years: Sequence[int] | None) -> DataFrame:
    """Orders with the region of their customer."""
    orders = _load(spark, sf_dir, "orders")
    if years is not None:
        orders = orders.where(in_years(F.col("o_orderdate"), years))
    customers = _load(spark, sf_dir, "customer").join(
        _load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def _placed_lines(spark: SparkSession, sf_dir: str, years: Sequence[int] | None) -> DataFrame:
    lines = _load(spark, sf_dir, "lineitem")
    return lines.join(_placed_orders(spark, sf_dir, years), F.col("l_orderkey") == F.col("o_orderkey"))


def _state() -> Column:
    return (F.col("n_regionkey") + 11).cast("string")


def _age() -> Column:
    return F.floor((F.col("l_quantity") - 1) * 1.8).cast("int")


def raw_deaths(
    spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    unreadable = (F.col("l_linenumber") >= 6) & (F.col("l_returnflag") == "R")
    return _placed_lines(spark, sf_dir, years).select(
        F.concat(_state(), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")).alias("mun_code"),
        F.when(F.col("l_linenumber") == 7, "9")
        .when(F.col("l_linestatus") == "F", "2")
        .otherwise("1")
        .alias("sex_code"),
        F.when(unreadable, "ign").otherwise(_age().cast("string")).alias("age_years"),
        F.col("o_orderdate").cast("date").alias("death_date"),
        *[column.alias(name) for name, column in (extra or {}).items()],
    )


def raw_births(spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None) -> DataFrame:
    unreadable = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 10 == 0)
    return _placed_orders(spark, sf_dir, years).select(
        F.concat(_state(), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("mun_code"),
        F.when(F.col("o_orderstatus") == "F", "2")
        .when(F.col("o_orderstatus") == "O", "1")
        .otherwise("9")
        .alias("sex_code"),
        F.when(unreadable, "ign")
        .otherwise((12 + F.col("o_orderkey") % 36).cast("string"))
        .alias("mother_age"),
        F.year("o_orderdate").alias("year"),
    )


def raw_population(
    spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None, all_ages: bool = False, breaks: Sequence[int] = tuple(range(0, 85, 5))
) -> DataFrame:
    """Population rows per labelled age band; with ``all_ages`` also the total rows of a published table."""
    band = band_of(_age(), breaks, None)
    keys = {
        "year": F.year("o_orderdate"),
        "geo_code": _state(),
        "sex_label": F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male"),
        "b": band,
    }
    lines = _placed_lines(spark, sf_dir, years).select(*[c.alias(name) for name, c in keys.items()])
    cells = lines.groupBy(*keys).agg(F.count("*").alias("pop"))
    first, last = F.col("b").cast("string"), (F.col("b") + band_width(F.col("b"), breaks) - 1).cast("string")
    label = (
        F.when(F.col("b").isNull(), "Total")
        .when(F.col("b") == breaks[-1], f"From {breaks[-1]} years or more")
        .otherwise(F.concat(F.lit("From "), first, F.lit(" to "), last, F.lit(" years")))
    )
    if all_ages:
        cols = [F.col(c) for c in keys]
        cells = cells.groupingSets([cols, cols[:3]], *cols).agg(F.sum("pop").alias("pop"))
    return cells.select("year", "geo_code", "sex_label", label.alias("age_label"), "pop")


def geo_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _load(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 11).cast("string").alias("geo_code"),
        F.col("r_name").alias("geo_name"),
        F.col("r_regionkey").cast("int").alias("geo_ord"),
    )
    return places.unionByName(
        spark.sql("SELECT 'BR' AS geo_code, 'TOTAL' AS geo_name, 99 AS geo_ord")
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 11).cast("string").alias("geo_code"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).cast("binary").alias("geometry"),
    )
