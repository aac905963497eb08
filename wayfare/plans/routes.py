"""Frequent routes between grid cells: peak, recent, per window and rolling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.cells import (
    cell_500m_number,
    cell_deg,
    cell_name,
    cells_east_500m,
    cells_south_500m,
    in_500m_grid,
)
from wayfare.functions.times import window_start
from wayfare.operators.cleaning import located_trips, non_loops
from wayfare.operators.intervals import counts_at_ticks
from wayfare.operators.ranking import pad_ranks, ranked, top_k, widen_ranks
from wayfare.operators.sequence import previous_value
from wayfare.session import cut_lineage

WINDOW_SECONDS = 30 * 60
TOP = 10

ROUTE = ["start_cell", "end_cell"]


def route_order(count: str = "num_rides"):
    """Most rides first; equal routes by name."""
    return [F.desc(count), F.asc("start_cell"), F.asc("end_cell")]


def with_degree_cells(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "start_cell": cell_deg("pickup_latitude", "pickup_longitude"),
            "end_cell": cell_deg("dropoff_latitude", "dropoff_longitude"),
        }
    )


def with_500m_cells(df: DataFrame) -> DataFrame:
    """Trips inside the 500 m grid at both ends, with their cells.

    Positions are columns of their own first, so each is worked out once per trip.
    """
    at = {
        "__sx": cells_east_500m("pickup_latitude", "pickup_longitude"),
        "__sy": cells_south_500m("pickup_latitude"),
        "__ex": cells_east_500m("dropoff_latitude", "dropoff_longitude"),
        "__ey": cells_south_500m("dropoff_latitude"),
    }
    inside = df.withColumns(at).filter(
        reduce(lambda a, b: a & b, [in_500m_grid(c) for c in at])
    )
    return inside.withColumns(
        {
            "start_cell": cell_name(cell_500m_number("__sx"), cell_500m_number("__sy")),
            "end_cell": cell_name(cell_500m_number("__ex"), cell_500m_number("__ey")),
        }
    ).drop(*at)


def route_counts(df: DataFrame, *by: str, out: str = "num_rides") -> DataFrame:
    return df.groupBy(*by, *ROUTE).agg(F.count(F.lit(1)).alias(out))


def window_counts(df: DataFrame, size: int = WINDOW_SECONDS) -> DataFrame:
    """Trips per tumbling window of their dropoff."""
    return df.groupBy(window_start("dropoff_unix", size).alias("window_start")).agg(
        F.count(F.lit(1)).alias("num_rides")
    )


def peak_window(df: DataFrame, size: int = WINDOW_SECONDS) -> DataFrame:
    """The window with the most trips, the earliest on ties."""
    return top_k(window_counts(df, size), 1, F.desc("num_rides"), F.asc("window_start"))


def peak_window_routes(df: DataFrame, k: int = TOP, size: int = WINDOW_SECONDS) -> DataFrame:
    """The k most frequent non-loop routes of the busiest window.

    The window's start is a scalar subquery, so the second pass filters at the scan.
    """
    located = located_trips(df)
    start = peak_window(located, size).select("window_start").scalar()
    inside = located.filter(
        (F.col("dropoff_unix") >= start) & (F.col("dropoff_unix") < start + size)
    )
    return top_k(non_loops(route_counts(with_degree_cells(inside))), k, *route_order())


def recent_routes(df: DataFrame, minutes: int = 30, k: int = TOP) -> DataFrame:
    """The k most frequent routes of the last minutes before the latest dropoff."""
    latest = df.agg(F.max("dropoff_unix").alias("latest")).scalar()
    recent = df.filter(F.col("dropoff_unix") > latest - minutes * 60)
    return top_k(route_counts(with_degree_cells(recent)), k, *route_order())


def windowed_routes(df: DataFrame, size: int = WINDOW_SECONDS) -> DataFrame:
    """Routes per tumbling window: (window_start, window_end, start_cell, end_cell, n)."""
    placed = with_degree_cells(df).withColumn("window_start", window_start("dropoff_unix", size))
    counted = route_counts(placed, "window_start", out="number_of_rides")
    return counted.withColumn("window_end", F.col("window_start") + size)


def latest_window_routes(windows: DataFrame, seconds: int = WINDOW_SECONDS, k: int = TOP) -> DataFrame:
    """The k most frequent (window, route) rows of windows that end in the last `seconds`."""
    latest = windows.agg(F.max("window_end").alias("latest")).scalar()
    recent = windows.filter(F.col("window_end") >= latest - seconds)
    return top_k(
        recent, k, F.desc("number_of_rides"), F.asc("window_start"), *route_order()[1:]
    )


def window_totals(windows: DataFrame) -> DataFrame:
    return windows.groupBy("window_start", "window_end").agg(
        F.sum("number_of_rides").alias("total_rides")
    )


def top_windows(windows: DataFrame) -> DataFrame:
    """All windows whose total equals the greatest total."""
    totals = window_totals(windows)
    most = totals.agg(F.max("total_rides").alias("most")).scalar()
    return totals.filter(F.col("total_rides") == most)


def ranked_top_windows(windows: DataFrame, k: int = TOP, ties: bool = True) -> DataFrame:
    """The k first routes of every top window, with ranks 1..k padded by NULL.

    With ties equal counts share a rank, so a window may have more than k rows.
    """
    top = top_windows(windows).select("window_start", "window_end")
    rows = windows.join(top, ["window_start", "window_end"])
    order = route_order("number_of_rides")
    kept = ranked(rows, ["window_start", "window_end"], order[:1] if ties else order, k, ties)
    return pad_ranks(top, kept, ["window_start", "window_end"], k)


def rolling_counts(df: DataFrame, span: int = WINDOW_SECONDS, step: int = 60) -> DataFrame:
    """Rides per route in the `span` up to every minute: (tick, start_cell, end_cell, num_rides)."""
    return counts_at_ticks(with_degree_cells(df), "dropoff_unix", ROUTE, span, step)


def rolling_ranks(df: DataFrame, k: int = TOP, ties: bool = False) -> DataFrame:
    """The k first routes at every minute, long form."""
    order = route_order()
    return ranked(rolling_counts(df), ["tick"], order[:1] if ties else order, k, ties)


def rolling_routes(df: DataFrame, k: int = TOP) -> DataFrame:
    """One row per minute: start_cell_id_1, end_cell_id_1, ... of its k first routes."""
    wide = widen_ranks(
        rolling_ranks(df, k),
        ["tick"],
        {"start_cell": "start_cell_id", "end_cell": "end_cell_id"},
        k,
    )
    return wide.withColumn("delay", F.lit(0))


def rolling_changes(df: DataFrame, k: int = TOP) -> DataFrame:
    """Minutes at which the set of the k first routes differs from the minute before.

    The ticks form one time line, as many rows as minutes, which is cut into slices when
    it is long.
    """
    route = F.concat("start_cell", F.lit(">"), "end_cell")
    sets = rolling_ranks(df, k).filter(route.isNotNull()).groupBy("tick").agg(
        F.array_join(F.sort_array(F.collect_list(route)), ",").alias("routes")
    )
    # one short row a minute, but dear to work out: written once for the passes below
    linked = previous_value(cut_lineage(sets), [], ["tick"], "routes", "previous_routes")
    changed = linked.filter(~F.col("routes").eqNullSafe(F.col("previous_routes")))
    return changed.select("tick", "routes")
