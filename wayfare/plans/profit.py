"""Profitable areas: median fare and tip of a cell against the empty taxis in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.cells import (
    cell_250m,
    cell_250m_number,
    cell_name,
    cells_east_250m,
    cells_south_250m,
    in_250m_grid,
)
from wayfare.functions.measures import profitability
from wayfare.functions.times import window_start
from wayfare.operators.intervals import ticks_between
from wayfare.operators.medians import exact_median
from wayfare.operators.quantiles import SMALL_GROUP, exact_quantiles
from wayfare.operators.ranking import ranked, widen_ranks

PROFIT_SECONDS = 15 * 60
EMPTY_SECONDS = 30 * 60
TOP = 10
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)

CELL = ["cell_x", "cell_y"]


def with_250m_cells(df: DataFrame) -> DataFrame:
    """Trips inside the 250 m grid at both ends, with the four cell numbers."""
    at = {
        "start_cell_x": cells_east_250m("pickup_latitude", "pickup_longitude"),
        "start_cell_y": cells_south_250m("pickup_latitude"),
        "end_cell_x": cells_east_250m("dropoff_latitude", "dropoff_longitude"),
        "end_cell_y": cells_south_250m("dropoff_latitude"),
    }
    measured = df.withColumns(at)
    inside = measured.filter(reduce(lambda a, b: a & b, [in_250m_grid(c) for c in at]))
    return inside.withColumns(
        {c: cell_250m_number(c) for c in at}
        | {"fare_plus_tip": F.col("fare_amount") + F.col("tip_amount")}
    )


def with_end_cells(df: DataFrame) -> DataFrame:
    """All trips with their end cell, NULL outside the 250 m grid.

    Trips that start or end off the grid stay, as do those of any length: their pickup makes a
    taxi busy.
    """
    cell = cell_250m("dropoff_latitude", "dropoff_longitude")
    return df.withColumn("__cell", cell).withColumns(
        {"end_cell_x": F.col("__cell.x"), "end_cell_y": F.col("__cell.y")}
    ).drop("__cell")


def profit_by_cell(placed: DataFrame, size: int = PROFIT_SECONDS, limit: int = SMALL_GROUP) -> DataFrame:
    """Median fare and tip per (dropoff window, pickup cell), an element of the group."""
    rows = placed.select(
        window_start("dropoff_unix", size).alias("window_start"),
        F.col("start_cell_x").alias("cell_x"),
        F.col("start_cell_y").alias("cell_y"),
        "fare_plus_tip", "pickup_unix", "dropoff_unix",
    )
    found = exact_quantiles(
        rows, ["window_start", *CELL], "fare_plus_tip", [0.5],
        F.max("pickup_unix").alias("trigger_pickup"), F.max("dropoff_unix").alias("trigger_dropoff"), limit=limit)
    return found.select("window_start", *CELL, F.get("quantiles", 0).alias("median_fare_tip"), "trigger_pickup",
                        "trigger_dropoff")


def exact_profit_by_cell(placed: DataFrame, size: int = PROFIT_SECONDS) -> DataFrame:
    """As `profit_by_cell` with the exact median, which may lie between two fares."""
    rows = placed.select(
        window_start("dropoff_unix", size).alias("window_start"),
        F.col("start_cell_x").alias("cell_x"),
        F.col("start_cell_y").alias("cell_y"),
        "fare_plus_tip",
    )
    return exact_median(rows, ["window_start", *CELL], "fare_plus_tip", "median_fare_tip")


def taxis_by_cell(placed: DataFrame, size: int = EMPTY_SECONDS, exact: bool = True) -> DataFrame:
    """Distinct taxis per (dropoff window, dropoff cell)."""
    taxis = F.count_distinct("medallion") if exact else F.approx_count_distinct("medallion")
    return placed.groupBy(
        window_start("dropoff_unix", size).alias("window_start"),
        F.col("end_cell_x").alias("cell_x"),
        F.col("end_cell_y").alias("cell_y"),
    ).agg(taxis.alias("empty_taxis"))


def taxi_sketches(placed: DataFrame, size: int = PROFIT_SECONDS) -> DataFrame:
    """A mergeable sketch of the taxis per (dropoff window, dropoff cell), to be kept as a table.

    Windows of any multiple of `size` follow from it without another look at the trips.
    """
    return placed.groupBy(
        window_start("dropoff_unix", size).alias("window_start"),
        F.col("end_cell_x").alias("cell_x"),
        F.col("end_cell_y").alias("cell_y"),
    ).agg(F.hll_sketch_agg("medallion", SKETCH_BITS).alias("taxis"))


def taxis_from_sketches(sketches: DataFrame, size: int = EMPTY_SECONDS) -> DataFrame:
    """Distinct taxis per wider window and cell, to about SKETCH_ERROR (one standard deviation)."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("taxis"))
    return sketches.groupBy(window_start("window_start", size).alias("window_start"), *CELL).agg(
        merged.alias("empty_taxis"))


def taxi_events(ended: DataFrame, *kept: str) -> DataFrame:
    """Pickup and dropoff of every trip of a known taxi as two rows, in one pass; `kept` come along.

    `event` orders a taxi's events: by second, pickups before dropoffs, then by trip.
    """
    none = F.lit(None).cast("int")

    def event(at, is_dropoff, x, y):
        return F.struct(
            F.struct(
                F.col(at).alias("at"), F.lit(is_dropoff).alias("is_dropoff"), "trip_id",
                x.alias("cell_x"), y.alias("cell_y"),
            ).alias("event")
        )

    return ended.filter(F.col("medallion").isNotNull()).select(
        "medallion",
        *kept,
        F.inline(
            F.array(
                event("pickup_unix", 0, none, none),
                event("dropoff_unix", 1, F.col("end_cell_x"), F.col("end_cell_y")),
            )
        ),
    )


def events_at_ticks(events: DataFrame, step: int, span: int) -> DataFrame:
    """Every event once per tick it can matter for: the ticks up to `span` after it."""
    at = F.col("event.at")
    return events.select("*", F.explode(ticks_between(at, at + span, step)).alias("tick"))


def in_cells(latest: DataFrame) -> DataFrame:
    """Taxis per tick and cell, of those whose latest event is a dropoff on the grid."""
    return (
        latest.filter(F.col("event.cell_x").isNotNull())  # a pickup has no cell
        .groupBy("tick", F.col("event.cell_x").alias("cell_x"),
                 F.col("event.cell_y").alias("cell_y"))
        .agg(F.count(F.lit(1)).alias("empty_taxis"))
    )


def empty_taxis(ended: DataFrame, step: int = PROFIT_SECONDS,
                span: int = EMPTY_SECONDS) -> DataFrame:
    """Empty taxis per cell at every multiple of `step`: (tick, cell_x, cell_y, empty_taxis).

    `ended` are trips of `with_end_cells`. At time T a taxi is empty in the cell of its
    latest dropoff if that was at most `span` ago and no pickup followed up to T, that is,
    if its latest event is that dropoff. The latest event per taxi and tick is a maximum,
    which tasks merge before the shuffle, so a busy taxi is no larger a group than others.
    """
    return in_cells(
        events_at_ticks(taxi_events(ended), step, span)
        .groupBy("medallion", "tick")
        .agg(F.max("event").alias("event"))
    )


def profitable_areas(placed: DataFrame, ended: DataFrame, k: int = TOP,
                     step: int = PROFIT_SECONDS) -> DataFrame:
    """The k most profitable cells at the end of every window, long form.

    `placed` are trips of `with_250m_cells`, `ended` those of `with_end_cells`.

    (tick, rank, cell_x, cell_y, median_fare_tip, empty_taxis, profitability). Cells
    without empty taxis have no profitability and come last.
    """
    profit = profit_by_cell(placed, step).withColumn("tick", F.col("window_start") + step)
    joined = profit.join(empty_taxis(ended, step), ["tick", *CELL], "left").select(
        "tick",
        *CELL,
        "median_fare_tip",
        F.coalesce("empty_taxis", F.lit(0)).alias("empty_taxis"),
        "trigger_pickup",
        "trigger_dropoff",
    )
    scored = joined.withColumn("profitability", profitability("median_fare_tip", "empty_taxis"))
    order = [F.desc_nulls_last("profitability"), F.desc("median_fare_tip"), F.asc("cell_x"),
             F.asc("cell_y")]
    return ranked(scored, ["tick"], order, k)


def profitable_areas_wide(areas: DataFrame, k: int = TOP) -> DataFrame:
    """One row per tick with four columns per rank, as in the change feed."""
    named = areas.withColumn("cell", cell_name("cell_x", "cell_y"))
    return widen_ranks(
        named,
        ["tick"],
        {
            "cell": "profitable_cell_id",
            "empty_taxis": "empty_taxies_in_cell_id",
            "median_fare_tip": "median_profit_in_cell_id",
            "profitability": "profitability_of_cell",
        },
        k,
    )


def profitability_by_window(placed: DataFrame) -> DataFrame:
    """15-minute profit joined with the distinct taxis of the 30-minute window around it."""
    profit = profit_by_cell(placed).withColumn(
        "empty_start", window_start("window_start", EMPTY_SECONDS)
    )
    taxis = taxis_by_cell(placed).withColumnRenamed("window_start", "empty_start")
    joined = profit.join(taxis, ["empty_start", *CELL])
    return joined.withColumn("profitability", profitability("median_fare_tip", "empty_taxis"))
