"""Trips as keyed messages: `(key, value, timestamp)` with the trip as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encode(df: DataFrame, key: str = "medallion") -> DataFrame:
    """(key, value): the key column as text, the whole row as JSON."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def decode(messages: DataFrame, schema: str) -> DataFrame:
    """The rows in `value`, with the key and arrival time; all-NULL for other payloads."""
    parsed = messages.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("timestamp").alias("kafka_timestamp"),
        F.from_json(F.col("value").cast("string"), schema).alias("data"),
    )
    return parsed.select("kafka_key", "kafka_timestamp", "data.*")


def publish_kafka(df: DataFrame, servers: str, topic: str, key: str = "medallion") -> None:
    """Send every row once. Messages of one key share a topic partition and keep their order.

    Needs the Kafka connector on the class path.
    """
    encode(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def publish_files(df: DataFrame, path: str, timestamp, key: str = "medallion",
                  mode: str = "append") -> None:
    """The same messages as files, for a stream without a broker."""
    encoded = df.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct("*")).alias("value"),
        timestamp.alias("timestamp"),
    )
    encoded.write.mode(mode).parquet(path)


def subscribe_kafka(spark: SparkSession, servers: str, topic: str,
                    starting: str = "earliest", **options) -> DataFrame:
    """A stream of messages from a topic. Needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**options)
        .load()
    )


def sliced(df: DataFrame, n: int, key: str) -> DataFrame:
    """Add `slice` 0..n-1: contiguous key ranges of about equal size, in one range shuffle."""
    return df.repartitionByRange(n, key).withColumn("slice", F.spark_partition_id())
