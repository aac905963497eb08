"""Change feeds: a row whenever the k first entries of the newest closed window change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.operators.ranking import rank_columns, ranked
from wayfare.operators.sequence import previous_value
from wayfare.streaming.run import publish, read_published, start, write_batch


FEW_WINDOWS = 10_000


def window_entries(rows: DataFrame, order, k: int, entry, ordered: bool,
                   values: dict[str, str]) -> DataFrame:
    """One row per window: its k first entries, what stands at each rank, and its latest times.

    `rows` has window_start and window_end (epoch seconds), trigger_pickup,
    trigger_dropoff, ingested (timestamps) and the columns in `values`; `entry` names a
    row. Entries are listed in order if `ordered`, else as a set.
    """
    top = ranked(rows.withColumn("entry", entry), ["window_start"], order, k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "entry")))["entry"]  # k at most
    if not ordered:
        listed = F.array_sort(F.collect_set("entry"))
    placed = rank_columns(values, k)
    return top.groupBy("window_start", "window_end").agg(
        F.array_join(listed, ",").alias("entries"),
        F.max(F.struct("trigger_dropoff", "trigger_pickup", "ingested")).alias("latest"),
        *placed,
    )


def _linked(known: DataFrame, few: bool) -> DataFrame:
    """Every window with the entries of the window before; few windows are one line in one task."""
    if few:
        return known.withColumn("before", F.lag("entries").over(Window.orderBy("window_start")))
    return previous_value(known, [], ["window_start"], "entries", "before")


def changed(windows: DataFrame, k: int, values: dict[str, str], last: DataFrame | None = None,
            few: bool = False) -> DataFrame:
    """Windows of `window_entries` whose entries differ from those of the window before.

    `last` holds the newest (window_start, entries) already known. `few` says that there are at most
    about FEW_WINDOWS; the result is the same.
    """
    known = windows.withColumn("new", F.lit(True))
    if last is not None:
        known = known.unionByName(last.withColumn("new", F.lit(False)), allowMissingColumns=True)
    linked = _linked(known, few)
    differ = linked.filter(F.col("new") & ~F.col("entries").eqNullSafe(F.col("before")))
    now = F.unix_micros(F.current_timestamp())
    return differ.select(
        "window_start",
        "window_end",
        F.col("latest.trigger_pickup").alias("pickup_datetime"),
        F.col("latest.trigger_dropoff").alias("dropoff_datetime"),
        *[f"{prefix}_{i}" for i in range(1, k + 1) for prefix in values.values()],
        ((now - F.unix_micros(F.col("latest.ingested"))) / F.lit(1e6)).alias("delay"),
        "entries",
    )


def changes(rows: DataFrame, order, k: int, entry, ordered: bool, values: dict[str, str],
            last: DataFrame | None = None) -> DataFrame:
    """Windows whose k first entries differ from those of the window before."""
    return changed(window_entries(rows, order, k, entry, ordered, values), k, values, last)


def run_changes(windows: DataFrame, order, k: int, entry, ordered: bool,
                values: dict[str, str], path: str, checkpoint: str,
                every: str | None = None) -> StreamingQuery:
    """Write the change feed of a stream of closed windows.

    What the feed said last is one row beside the checkpoint, replaced after each batch that
    brought a change, so the feed survives a restart and never reads its own history. A repeated
    micro-batch replaces its rows; one without a change writes nothing.
    """
    said = f"{checkpoint}/said"

    def emit(batch: DataFrame, batch_id: int) -> None:
        # one row a window, used more than once: the stateful part must run but once
        closed = window_entries(batch, order, k, entry, ordered, values).persist()
        number = closed.count()
        if number:
            last = read_published(batch.sparkSession, said, batch_id)
            found = changed(closed, k, values, last, few=number <= FEW_WINDOWS).persist()
            newest = found.agg(F.max_by(F.struct("window_start", "entries"), "window_start").alias("said")).first()[0]
            if newest is not None:  # one window and its k entries
                write_batch(found, batch_id, path)
                row = batch.sparkSession.createDataFrame([newest], "window_start long, entries string")
                publish(row.coalesce(1), said, batch_id)
            found.unpersist()
        closed.unpersist()

    writer = windows.writeStream.outputMode("append").foreachBatch(emit)
    return start(writer.option("checkpointLocation", checkpoint), every)
