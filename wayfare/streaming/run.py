"""Starting, draining and watching streaming queries, and the sinks they write to."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Versions of a replaced table are kept in this many folders, each overwritten in its turn.
VERSIONS = 3
MARK = re.compile(r"/done/slot=(\d+)/version=(\d+)/")


def start(writer, every: str | None = None) -> StreamingQuery:
    """Start with a processing-time trigger, or process what is there and stop."""
    if every:
        return writer.trigger(processingTime=every).start()
    return writer.trigger(availableNow=True).start()


def drain(query: StreamingQuery) -> StreamingQuery:
    """Wait until a query that stops by itself has stopped; its error is raised here."""
    query.awaitTermination()
    return query


def append_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None,
                 name: str | None = None, fmt: str = "parquet", **options) -> StreamingQuery:
    """Append finished rows to a table, exactly once."""
    writer = df.writeStream.outputMode("append").format(fmt).options(**options)
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    return start(writer.queryName(name) if name else writer, every)


def newest_slot(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, int] | None:
    """(version, slot) of the newest finished version, or of the newest below `before`.

    Marks are found by their names, so nothing is read that a writer may be replacing.
    """
    reader = spark.read.schema("marked boolean").option("ignoreMissingFiles", True)
    try:
        files = reader.parquet(f"{path}/done").inputFiles()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    marks = [(int(m[2]), int(m[1])) for m in map(MARK.search, files) if m]
    return max((m for m in marks if before is None or m[0] < before), default=None)


def publish(df: DataFrame, path: str, version: int) -> None:
    """Replace a table by a new version, which counts once its mark is written.

    The slot after that of the version before is overwritten, so repeating a version replaces it
    and a reader of one of the last versions is not disturbed.
    """
    spark = df.sparkSession
    before = newest_slot(spark, path, version)
    slot = (before[1] + 1) % VERSIONS if before else 0
    df.write.mode("overwrite").parquet(f"{path}/data/slot={slot}")
    mark = spark.range(1).select(F.lit(True).alias("marked"), F.lit(version).alias("version"))
    mark.write.mode("overwrite").partitionBy("version").parquet(f"{path}/done/slot={slot}")


def read_published(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version written by `publish`; None when there is none yet."""
    found = newest_slot(spark, path, before)
    return spark.read.parquet(f"{path}/data/slot={found[1]}") if found else None


def complete_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None,
                   name: str | None = None) -> StreamingQuery:
    """Rewrite the whole result at every trigger. Read it with `read_complete`.

    State and work grow with all history; `append_table` of closed windows and `update_table`
    do not rewrite what has not changed.
    """
    writer = df.writeStream.outputMode("complete").foreachBatch(
        lambda batch, batch_id: publish(batch, path, batch_id)
    )
    writer = writer.option("checkpointLocation", checkpoint)
    return start(writer.queryName(name) if name else writer, every)


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    """The newest version written by `complete_table`.

    It stays readable until VERSIONS - 1 newer ones are finished.
    """
    found = read_published(spark, path)
    if found is None:
        raise ValueError(f"no finished version in {path}")
    return found


def update_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None,
                 name: str | None = None) -> StreamingQuery:
    """Write the rows that changed at every trigger. Read them with `read_updates`."""
    writer = df.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, path)
    )
    writer = writer.option("checkpointLocation", checkpoint)
    return start(writer.queryName(name) if name else writer, every)


def read_updates(spark: SparkSession, path: str, keys) -> DataFrame:
    """The latest row of every key written by `update_table`.

    The newest batch is a maximum per key, which tasks merge before the shuffle.
    """
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("__newest"))
    return newest.select(*keys, "__newest.*")


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Append one micro-batch so that repeating it replaces it."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def console(df: DataFrame, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Show rows while developing."""
    return start(df.writeStream.outputMode(mode).format("console").option("truncate", False), every)


def active_queries(spark: SparkSession) -> list[dict]:
    """Name, state and status of the running queries."""
    return [
        {"name": q.name, "id": q.id, "active": q.isActive, **q.status}
        for q in spark.streams.active
    ]


def progress(query: StreamingQuery) -> list[dict]:
    """Batch id, input rows and duration of the recent micro-batches."""
    return [
        {
            "batch_id": p["batchId"],
            "rows": p["numInputRows"],
            "milliseconds": p["batchDuration"] if "batchDuration" in p else None,
        }
        for p in query.recentProgress
    ]
