"""Batch files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _with_corrupt(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())


def read_csv(spark: SparkSession, path, schema: str | None = None, header: bool = True,
             **options) -> DataFrame:
    """CSV files, also by glob or list. Without a schema Spark reads the data twice to infer it."""
    reader = spark.read.options(header=header, **options)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_csv_permissive(spark: SparkSession, path, schema: str, header: bool = True) -> DataFrame:
    """Rows that do not fit the schema keep their text in `_corrupt_record`."""
    return (
        spark.read.schema(_with_corrupt(schema))
        .options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
        .csv(path)
    )


def read_csv_spaced(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV whose header and values have blanks after the commas."""
    return read_csv(
        spark, path, schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
        enforceSchema=True,
    )


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without blanks around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def with_file_name(df: DataFrame, out: str = "file_name", level: int = 1) -> DataFrame:
    """The file each row comes from, or with level=2 its folder."""
    return df.withColumn(out, F.element_at(F.split(F.input_file_name(), "/"), -level))


def read_parquet(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """Parquet; a schema limits what is read to its columns. A missing path raises."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_table(spark: SparkSession, place: str, fmt: str = "parquet") -> DataFrame:
    """A table by path (anything with a slash) or by catalog name."""
    if "/" in place:
        return spark.read.format(fmt).load(place)
    return spark.table(place)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=(), **options) -> None:
    """Write once; `partition_by` columns become folders that readers can prune."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        # rows of a folder meet in few tasks, so folders do not fill with tiny files; adaptive
        # execution splits the folders that are too large for one task
        writer = df.hint("rebalance", *partition_by).write.format(fmt).mode(mode).options(
            **options
        ).partitionBy(*partition_by)
    writer.save(path)


def replace_partitions(df: DataFrame, path: str, partition_by, fmt: str = "parquet") -> None:
    """Replace the folders that `df` has rows for; all others keep their files as they are."""
    write_table(df, path, fmt, partition_by=partition_by, partitionOverwriteMode="dynamic")


def in_top_partitions(table: DataFrame, column: str, counted: DataFrame | None = None) -> DataFrame:
    """Rows of the partitions of `table` with the most rows, ties included; NULL is a partition, too.

    The list of them has at most one row per folder. It is known before the scan begins, which
    then opens those folders only. `counted` stands in for the rows to be counted.
    """
    counts = (table if counted is None else counted).groupBy(column).agg(F.count(F.lit(1)).alias("__rows"))
    most = counts.agg(F.max("__rows")).scalar()
    top = counts.filter(F.col("__rows") == most).select(column)
    # null-safe equality hides the column from pruning, so NULL has a scan of its own folder
    nulls = counts.filter(F.col(column).isNull()).select("__rows").scalar()
    named = table.join(F.broadcast(top), column, "left_semi").select(*table.columns)
    return named.unionByName(table.filter(F.col(column).isNull() & (nulls == most)))


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite",
              **options) -> None:
    df.write.mode(mode).options(header=header, **options).csv(path)
