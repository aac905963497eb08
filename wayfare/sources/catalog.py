"""Named tables over written data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
                   replace: bool = False) -> DataFrame:
    """An external table over `path`, which must hold data already."""
    spark.read.format(fmt).load(path)  # raises when there is nothing to register
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING {fmt} LOCATION '{path}'")
    return spark.table(name)


def register_results(spark: SparkSession, tables: dict[str, str], fmt: str = "parquet") -> None:
    """One external table per name and path."""
    for name, path in tables.items():
        register_table(spark, name, path, fmt)


def analyze(spark: SparkSession, name: str) -> DataFrame:
    """Compute table statistics for the optimizer and return them as (table_name, statistics)."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    described = spark.sql(f"DESCRIBE EXTENDED {name}")
    return described.filter(F.col("col_name") == "Statistics").select(
        F.lit(name).alias("table_name"), F.col("data_type").alias("statistics")
    )


def describe(spark: SparkSession, name: str) -> DataFrame:
    """(column_name, data_type) in table order."""
    return spark.sql(f"DESCRIBE {name}").select(
        F.col("col_name").alias("column_name"), "data_type"
    )


def tables_like(spark: SparkSession, pattern: str) -> DataFrame:
    """Names of the catalog tables that fit a SHOW TABLES pattern."""
    return spark.sql(f"SHOW TABLES LIKE '{pattern}'").select(
        F.col("tableName").alias("table_name")
    )
