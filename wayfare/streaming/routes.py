"""Frequent routes of a stream of clean trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.operators.cleaning import located_trips
from wayfare.plans.routes import (
    TOP,
    latest_window_routes,
    peak_window_routes,
    rolling_routes,
    route_order,
    with_500m_cells,
    with_degree_cells,
)
from wayfare.streaming.feeds import run_changes
from wayfare.streaming.run import complete_table

WINDOW = "30 minutes"
LATENESS = "30 minutes"

ROUTE_COLUMNS = {"start_cell": "start_cell_id", "end_cell": "end_cell_id"}


def event_window(size: str = WINDOW, slide: str | None = None, column: str = "dropoff_datetime"):
    """A tumbling window, or a sliding one when `slide` is given."""
    return F.window(column, size, slide) if slide else F.window(column, size)


def flat_window(df: DataFrame) -> DataFrame:
    """window_start and window_end in epoch seconds instead of the window struct."""
    return df.withColumns(
        {
            "window_start": F.unix_seconds("window.start"),
            "window_end": F.unix_seconds("window.end"),
        }
    ).drop("window")


def route_windows(trips: DataFrame, size: str = WINDOW, slide: str | None = None,
                  lateness: str = LATENESS) -> DataFrame:
    """Rides per window and route, cells in degrees."""
    counted = (
        with_degree_cells(trips)
        .withWatermark("dropoff_datetime", lateness)
        .groupBy(event_window(size, slide), "start_cell", "end_cell")
        .agg(F.count(F.lit(1)).alias("number_of_rides"))
    )
    return flat_window(counted)


def detailed_route_windows(trips: DataFrame, size: str = WINDOW, slide: str | None = None,
                           lateness: str = LATENESS) -> DataFrame:
    """Rides per window and 500 m route, with the latest times of each."""
    arrived = with_500m_cells(trips).withColumn("ingested", F.current_timestamp())
    counted = (
        arrived.withWatermark("dropoff_datetime", lateness)
        .groupBy(event_window(size, slide), "start_cell", "end_cell")
        .agg(
            F.count(F.lit(1)).alias("number_of_rides"),
            F.max("pickup_datetime").alias("trigger_pickup"),
            F.max("dropoff_datetime").alias("trigger_dropoff"),
            F.max("ingested").alias("ingested"),
        )
    )
    return flat_window(counted)


def run_route_windows(trips: DataFrame, path: str, checkpoint: str,
                      every: str | None = None, slide: str | None = None) -> StreamingQuery:
    """Keep the table of all windows up to date (complete mode, most rides first)."""
    ordered = route_windows(trips, slide=slide).orderBy(F.desc("number_of_rides"))
    return complete_table(ordered, path, checkpoint, every)


def run_route_changes(trips: DataFrame, path: str, checkpoint: str, k: int = TOP,
                      every: str | None = None, slide: str | None = None) -> StreamingQuery:
    """A row when the set of the k most frequent routes differs from the window before."""
    return run_changes(
        detailed_route_windows(trips, slide=slide),
        route_order("number_of_rides"),
        k,
        F.concat("start_cell", F.lit(">"), "end_cell"),
        False,
        ROUTE_COLUMNS,
        path,
        checkpoint,
        every,
    )


def frequent_routes(spark: SparkSession, trips: DataFrame, mode: str = "batch",
                    path: str | None = None, checkpoint: str | None = None,
                    every: str | None = None):
    """The frequent-routes question in either form.

    "batch" gives the peak-window routes; "rolling" the routes of every minute;
    "windows" those of the newest window of a windowed table; "stream" starts the change
    feed and returns its query.
    """
    if mode == "batch":
        return peak_window_routes(trips)
    if mode == "rolling":
        return rolling_routes(located_trips(trips))
    if mode == "windows":
        return latest_window_routes(trips)
    if mode == "stream":
        return run_route_changes(trips, path, checkpoint, every=every)
    raise ValueError(f"unknown mode {mode!r}")
