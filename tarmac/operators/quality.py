"""Data-quality checks.  Each returns the offending rows or counts; clean data
gives empty results or zeros."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.geo import outside_gb
from tarmac.model import SEVERITIES
from tarmac.operators.joins import orphans


def required_tables(spark: SparkSession, names: Sequence[str]) -> dict[str, bool]:
    return {name: spark.catalog.tableExists(name) for name in names}


def table_sizes(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Row count of each required table; NULL where the table is missing."""
    present = required_tables(spark, names)
    rows = [
        (spark.table(n).agg(F.count("*").alias("n_rows")) if present[n] else spark.range(1).select(F.lit(None).cast("bigint").alias("n_rows")))
        .select(F.lit(n).alias("table_name"), F.lit(present[n]).alias("present"), "n_rows")
        for n in names
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def unknown_severities(collision: DataFrame, column: str = "collision_severity") -> DataFrame:
    """Recorded severities outside the known ones, with their counts."""
    return (
        collision.where(~F.col(column).isin(*SEVERITIES)).groupBy(column).agg(F.count("*").alias("n"))
    )


def date_mismatches(collision: DataFrame) -> DataFrame:
    return collision.where(F.col("year") != F.year("date")).agg(F.count("*").alias("n_mismatch"))


def coordinate_violations(collision: DataFrame) -> DataFrame:
    return collision.where(outside_gb(F.col("latitude"), F.col("longitude"))).agg(
        F.count("*").alias("n_violations")
    )


def reconcile_with_monthly(collision: DataFrame, monthly: DataFrame) -> DataFrame:
    """Per year: collisions counted from the facts and from the monthly table."""
    raw = collision.groupBy("year").agg(F.count("*").alias("raw_total"))
    kpi = monthly.groupBy("year").agg(F.sum(F.col("fatal") + F.col("serious") + F.col("slight")).alias("kpi_total"))
    matched = F.col("raw.year").eqNullSafe(F.col("kpi.year"))
    return (
        raw.alias("raw")
        .join(kpi.alias("kpi"), matched, "full")
        .select(F.coalesce("raw.year", "kpi.year").alias("year"), "raw_total", "kpi_total")
    )


def orphan_counts(collision: DataFrame, **children: DataFrame) -> DataFrame:
    parts = [
        orphans(child, collision).agg(F.count("*").alias("n_orphans")).select(F.lit(name).alias("child"), "n_orphans")
        for name, child in children.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def invalid_labels(df: DataFrame, code_map: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Values of decoded columns that are no label of the code map, with counts.

    All columns are counted in one pass; only their distinct values meet the map.
    """
    seen = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "variable", "label")
        .where(F.col("label").isNotNull())
        .groupBy("variable", "label")
        .agg(F.count("*").alias("n"))
    )
    known = code_map.where(F.col("table") == table).select("variable", "label")
    return seen.join(known, ["variable", "label"], "left_anti")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, one pass, as (column_name, n_missing)."""
    names = df.columns
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names])
    return wide.unpivot([], names, "column_name", "n_missing")
