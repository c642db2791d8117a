"""SRC-1: typed scans of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomledger.schema import BASE_SCHEMAS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema (column pruning and filter
    pushdown stay with the scan)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(path)


def load_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    """Every table of a folder as a dict of lazily scanned DataFrames."""
    names = names or tuple(BASE_SCHEMAS)
    return {n: read_table(spark, sf_dir, n) for n in names}


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
              num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Production form of the scan: a partitioned JDBC read of an OLTP table,
    split on a numeric key so every executor reads a key range."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})
