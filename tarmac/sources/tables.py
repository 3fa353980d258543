"""Writing results and keeping aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.geo import point_wkt


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Files of text with a header.  ``gzip`` is written at its fastest level, which costs no more time than plain text."""
    df.write.mode("overwrite").option("header", True).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").csv(path)


def write_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    buckets: tuple[int, str] | None = None,
    path: str | None = None,
) -> None:
    """Create or replace a catalog table.

    ``buckets`` (number, column) stores rows hashed and sorted by a key.  Facts
    bucketed alike on the collision key join without shuffling either side.  Rows
    are dealt out by bucket first, so a bucket is one file per partition value.
    """
    if buckets:
        df = df.repartition(buckets[0], buckets[1])
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(buckets[0], buckets[1]).sortBy(buckets[1])
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[Column] = ()) -> None:
    """Parquet, one directory per partition value.

    Rows are rebalanced by the partition columns first: files come out evenly
    sized, and AQE splits a value that holds most of the rows.  ``sort_by`` clusters
    rows within files, so that ranges of it skip row groups.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def materialise(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[Column] = ()) -> DataFrame:
    """Write a result and return it as read back: repeated queries scan the file."""
    write_parquet(df, path, partition_by, sort_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_wkt(df: DataFrame, x: str = "longitude", y: str = "latitude", name: str = "geometry") -> DataFrame:
    return df.withColumn(name, point_wkt(F.col(x), F.col(y)))


#: Property of a table's view that names the version it shows.
_VERSION = "version"


def replace_table(
    df: DataFrame,
    database: str,
    name: str,
    root: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[Column] = (),
    buckets: tuple[int, str] | None = None,
) -> DataFrame:
    """Make rows the contents of ``database.name``, and return them as stored.

    Rows go to a version of their own, with files in a new folder below ``root``;
    ``database.name`` is a view of the version, and one statement of the catalog
    switches it.  Whoever reads the version before keeps reading it, and if
    writing fails nothing has changed.  Versions stay until ``forget_versions``.
    """
    spark = df.sparkSession
    versions = f"{database}_versions"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {versions} LOCATION '{root}/versions'")
    version = f"{name}__{uuid.uuid4().hex}"
    if partition_by and not buckets:
        df = df.hint("rebalance", *partition_by)
    if sort_by and not buckets:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    write_table(df, f"{versions}.{version}", partition_by, buckets, f"{root}/{name}/{version}")
    if spark.catalog.tableExists(f"{database}.{name}") and spark.catalog.getTable(f"{database}.{name}").tableType != "VIEW":
        spark.sql(f"DROP TABLE {database}.{name}")  # stored before there were versions; its files stay
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} TBLPROPERTIES ('{_VERSION}' = '{version}') AS SELECT * FROM {versions}.{version}")
    return spark.table(f"{versions}.{version}")


def old_versions(spark: SparkSession, database: str, name: str) -> list[str]:
    """Versions of a table that it no longer shows."""
    shown = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {database}.{name}").collect()}[_VERSION]
    listed = spark.sql(f"SHOW TABLES IN {database}_versions LIKE '{name.lower()}__*'").collect()
    return sorted(r.tableName for r in listed if r.tableName != shown)


def forget_versions(spark: SparkSession, database: str, name: str) -> list[str]:
    """Take old versions out of the catalog; returns their folders, which nobody may read any more before they are removed."""
    folders = []
    for version in old_versions(spark, database, name):
        detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {database}_versions.{version}").collect()}
        folders.append(detail["Location"])
        spark.sql(f"DROP TABLE {database}_versions.{version}")
    return folders


def existing_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))
