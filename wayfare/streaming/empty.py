"""Empty taxis of a stream of trips, without a limit on how long a trip may take."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfare.operators.intervals import ticks_between
from wayfare.plans.profit import EMPTY_SECONDS, PROFIT_SECONDS, in_cells, taxi_events, with_end_cells

LATENESS = "35 minutes"
BUCKETS_PER_TASK = 4

EVENT = ["medallion", "tick", "at", "is_dropoff", "trip_id", "cell_x", "cell_y"]
TOLD = "medallion string, tick long, at long, is_dropoff int, trip_id long, cell_x int, cell_y int"
STATE = ("medallion array<string>, tick array<long>, at array<long>, is_dropoff array<int>, trip_id array<long>,"
         " cell_x array<int>, cell_y array<int>")
NOWHERE = -1  # the cell of a pickup and of a dropoff off the grid


def _follow(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the latest event of every taxi before every open tick; tell it when the tick has closed.

    An event that becomes known when its tick has closed is told at once.
    """
    known = [pd.DataFrame(dict(zip(EVENT, state.get)))] if state.exists else []
    if not state.hasTimedOut:
        known += [frame[EVENT] for frame in frames]
    events = pd.concat(known) if known else pd.DataFrame(columns=EVENT)
    events = events.sort_values(EVENT).drop_duplicates(["medallion", "tick"], keep="last")
    watermark = state.getCurrentWatermarkMs()
    closed = events["tick"] * 1000 < watermark
    still = events[~closed]
    if len(still):
        state.update(tuple(still[c].tolist() for c in EVENT))
        state.setTimeoutTimestamp(max(int(still["tick"].min()) * 1000, watermark + 1))
    elif state.exists:
        state.remove()
    yield events[closed]


def taxi_claims(trips: DataFrame, step: int = PROFIT_SECONDS, span: int = EMPTY_SECONDS,
                lateness: str = LATENESS, buckets: int | None = None) -> DataFrame:
    """The latest event of every taxi before every tick, as a stream of rows (see `TOLD`).

    A row is told once the watermark has passed its tick. A pickup is known only at the dropoff: if a
    trip took longer than `lateness`, rows for the ticks it changes are told again, and the later event
    counts (`empty_taxis_told`). So nothing waits for the longest trip and no trip is left out.

    Taxis and ticks are independent, so a state is that of a bucket of (taxi, tick) pairs, by default
    four buckets a shuffle partition: a busy taxi is spread over all of them. It holds the open ticks
    alone. Rows stay right if the number of buckets changes at a restart.
    """
    if buckets is None:
        buckets = BUCKETS_PER_TASK * int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = taxi_events(with_end_cells(trips.withWatermark("dropoff_datetime", lateness)),
                         "dropoff_datetime")
    at = F.col("event.at")
    placed = events.select(
        "medallion", "dropoff_datetime", F.explode(ticks_between(at, at + span, step)).alias("tick"),
        at.alias("at"), "event.is_dropoff", F.col("event.trip_id").cast("long").alias("trip_id"),
        F.coalesce("event.cell_x", F.lit(NOWHERE)).alias("cell_x"),
        F.coalesce("event.cell_y", F.lit(NOWHERE)).alias("cell_y"),
    )
    keyed = placed.withColumn("bucket", F.pmod(F.xxhash64("medallion", "tick"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(
        _follow, TOLD, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def empty_taxis_told(claims: DataFrame) -> DataFrame:
    """Empty taxis per closed tick and cell from a table of `taxi_claims`.

    The latest event per taxi and tick is a maximum, which tasks merge before the shuffle.
    """
    cell = {c: F.when(F.col(c) != NOWHERE, F.col(c)) for c in ("cell_x", "cell_y")}
    event = F.struct("at", "is_dropoff", "trip_id", *[c.alias(n) for n, c in cell.items()])
    return in_cells(claims.groupBy("medallion", "tick").agg(F.max(event).alias("event")))
