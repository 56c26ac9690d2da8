"""Reading microdata and population files, and saving results between steps.

Nothing here infers a schema: text and Parquet files are read with the declared one, so a scan
starts without a pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcov.functions import scalars as S
from vitalcov.schemas import SCHEMAS, check_schema


def _scan(spark: SparkSession, path: str, name: str, fmt: str, options: dict) -> DataFrame:
    return spark.read.format(fmt).schema(SCHEMAS[name]).options(**options).load(path)


def read_deaths(
    spark: SparkSession, path: str, years: Sequence[int], fmt: str = "parquet", **options: str
) -> DataFrame:
    """Death records of ``years``, and those without a date.

    In a layout with ``year=`` folders (or a year column) the folders of other years are not opened, and a record without a
    date counts for the year of its folder. Without one it keeps a NULL year, so that no record is lost unseen.
    A record dated in a year that was not asked for is left out. The date test is a range, which Parquet uses to skip row groups.
    """
    raw = _scan(spark, path, "deaths_raw", fmt, options)
    filed = raw.where(F.col("year").isNull() | F.col("year").isin(*years))
    return filed.where(F.col("death_date").isNull() | S.in_years(F.col("death_date"), years))


def misfiled_deaths(spark: SparkSession, path: str, years: Sequence[int], fmt: str = "parquet", **options: str) -> DataFrame:
    """Number ``n`` of death records per year they are ``filed`` under and year they are ``dated`` in, where the two differ and one of them is among ``years``.

    Those dated in such a year but filed under another are what ``read_deaths`` leaves out unseen, as it does not open other years' folders. Two columns of all years are read for it.
    """
    raw = _scan(spark, path, "deaths_raw", fmt, options).select(F.col("year").alias("filed"), F.year("death_date").alias("dated"))
    apart = raw.where((F.col("filed") != F.col("dated")) & (F.col("filed").isin(*years) | F.col("dated").isin(*years)))
    return apart.groupBy("filed", "dated").agg(F.count("*").alias("n"))


def read_births(
    spark: SparkSession, path: str, years: Sequence[int], fmt: str = "parquet", **options: str
) -> DataFrame:
    """Birth records of ``years``; ``year`` is a column or a ``year=`` folder."""
    return _scan(spark, path, "births_raw", fmt, options).where(F.col("year").isin(*years))


def read_population(
    spark: SparkSession, path: str, years: Sequence[int], fmt: str = "parquet", **options: str
) -> DataFrame:
    """Population rows of ``years``, all-ages rows still included."""
    return _scan(spark, path, "population_raw", fmt, options).where(F.col("year").isin(*years))


def read_regions(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Region and boundary of each place; the boundary is carried as bytes and never interpreted."""
    return _scan(spark, path, "regions", fmt, options)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table saved by ``write_table``."""
    return check_schema(spark.read.schema(SCHEMAS[name]).parquet(path), name)


def write_table(df: DataFrame, path: str, name: str, rebalance: bool = False) -> None:
    """Save as Parquet, one folder per year where the schema has a year.

    Only the years present in ``df`` are replaced. With ``rebalance`` the rows are first spread into
    evenly sized files per year (a year that holds most rows is split over many tasks); use it for
    record-level tables, where every task would otherwise write a small file per year.
    """
    out = check_schema(df, name)
    if "year" not in out.columns:
        out.write.mode("overwrite").parquet(path)
        return
    if rebalance:
        out = out.hint("rebalance", F.col("year"))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year").parquet(path)
