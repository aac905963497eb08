"""Rows that come after their window has closed: kept apart, and merged when read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.functions.times import window_start
from wayfare.streaming.run import publish, read_published, start, write_batch

WINDOW_SECONDS = 30 * 60
LATENESS_SECONDS = 30 * 60


def run_routed(rows: DataFrame, timely: str, late: str, checkpoint: str, seconds: str = "dropoff_unix",
               size: int = WINDOW_SECONDS, lateness: int = LATENESS_SECONDS,
               every: str | None = None) -> StreamingQuery:
    """Append rows to the table `timely`, those whose window has closed to `late`.

    A window has closed when the newest event of the batches before is `lateness` past its end, so a
    stream that reads `timely` with that watermark drops no row: a row it would drop is in `late`.
    The newest event is one row beside the checkpoint. A repeated micro-batch replaces its rows.
    Rows without a time belong to no window and are timely.
    """
    seen = f"{checkpoint}/newest"

    def route(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        before = read_published(batch.sparkSession, seen, batch_id)
        newest = before.first()["newest"] if before is not None else None
        ends = window_start(seconds, size) + size
        gone = F.lit(False) if newest is None else F.coalesce(ends <= F.lit(newest - lateness), F.lit(False))
        write_batch(rows.filter(~gone), batch_id, timely)
        write_batch(rows.filter(gone), batch_id, late)
        now = rows.agg(F.greatest(F.max(seconds), F.lit(newest).cast("long")).alias("newest"))
        if not now.filter("newest IS NOT NULL").isEmpty():
            publish(now, seen, batch_id)
        rows.unpersist()

    writer = rows.writeStream.outputMode("append").foreachBatch(route)
    return start(writer.option("checkpointLocation", checkpoint), every)


def corrected(closed: DataFrame, late_counts: DataFrame, keys, counts) -> DataFrame:
    """Closed groups with the rows that came late: `counts` of equal `keys` are added up.

    Groups that had only late rows are new. The keys are summed in every task before the shuffle.
    """
    columns = [*keys, *counts]
    both = closed.select(*columns).unionByName(late_counts.select(*columns))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
