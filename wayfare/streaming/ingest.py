"""Messages to a raw table, and the raw table to a clean one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wayfare.operators.cleaning import clean_trips
from wayfare.schemas import ENVELOPE
from wayfare.sources.messages import decode
from wayfare.streaming.run import append_table


def file_stream(spark: SparkSession, path: str, schema: str,
                max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """New files of a folder; `max_files` per trigger slows a replay down."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages stored as files, in the layout a broker delivers."""
    return file_stream(spark, path, ENVELOPE, max_files)


def run_raw(messages: DataFrame, schema: str, path: str, checkpoint: str,
            every: str | None = None) -> StreamingQuery:
    """Decode messages and append them to the raw table."""
    return append_table(decode(messages, schema), path, checkpoint, every)


def run_clean(raw: DataFrame, path: str, checkpoint: str, every: str | None = None,
              rules=clean_trips) -> StreamingQuery:
    """Append the rows that pass the cleaning rules to the clean table."""
    return append_table(rules(raw), path, checkpoint, every)
