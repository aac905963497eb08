"""Profit, distinct taxis and profitability of a stream of clean trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.functions.cells import cell_name
from wayfare.functions.measures import profitability
from wayfare.operators.medians import median_element
from wayfare.plans.profit import (
    PROFIT_SECONDS,
    TOP,
    with_250m_cells,
)
from wayfare.streaming.feeds import run_changes
from wayfare.streaming.routes import flat_window

PROFIT_LATENESS = "20 minutes"
EMPTY_LATENESS = "35 minutes"

PROFIT_COLUMNS = {
    "cell": "profitable_cell_id",
    "empty_taxis": "empty_taxies_in_cell_id",
    "median_fare_tip": "median_profit_in_cell_id",
    "profitability": "profitability_of_cell",
}


def _profit(trips: DataFrame, lateness: str) -> DataFrame:
    return (
        with_250m_cells(trips)
        .withColumn("ingested", F.current_timestamp())
        .withWatermark("dropoff_datetime", lateness)
        .groupBy(
            F.window("dropoff_datetime", "15 minutes"),
            F.col("start_cell_x").alias("cell_x"),
            F.col("start_cell_y").alias("cell_y"),
        )
        .agg(
            median_element("fare_plus_tip").alias("median_fare_tip"),
            F.max("pickup_datetime").alias("trigger_pickup"),
            F.max("dropoff_datetime").alias("trigger_dropoff"),
            F.max("ingested").alias("ingested"),
        )
    )


def _taxis(trips: DataFrame, lateness: str, exact: bool) -> DataFrame:
    """The exact form keeps one entry per taxi, cell and window, the other a sketch per cell."""
    where = ["window", "cell_x", "cell_y"]
    placed = with_250m_cells(trips).withWatermark("dropoff_datetime", lateness).select(
        F.window("dropoff_datetime", "30 minutes").alias("window"),
        F.col("end_cell_x").alias("cell_x"),
        F.col("end_cell_y").alias("cell_y"),
        "medallion",
    )
    if not exact:
        return placed.groupBy(*where).agg(F.approx_count_distinct("medallion").alias("empty_taxis"))
    once = placed.groupBy(*where, "medallion").agg(F.count(F.lit(1)).alias("trips"))
    return once.groupBy(*where).agg(F.count("medallion").alias("empty_taxis"))


def profit_windows(trips: DataFrame, lateness: str = PROFIT_LATENESS) -> DataFrame:
    """Median fare and tip per 15-minute window and pickup cell."""
    return flat_window(_profit(trips, lateness))


def taxi_windows(trips: DataFrame, lateness: str = EMPTY_LATENESS, exact: bool = True) -> DataFrame:
    """Distinct taxis per 30-minute window and dropoff cell."""
    return flat_window(_taxis(trips, lateness, exact))


def profitability_windows(trips: DataFrame, exact: bool = True) -> DataFrame:
    """Profit per 15-minute window and cell with the distinct taxis of the 30-minute window around it.

    One state per half hour and cell holds both: a trip counts for the profit of its pickup cell and for
    the taxis of its dropoff cell. The exact number needs the set of taxis that stopped in a cell in half
    an hour, which is as large as a fleet at most; the other form keeps a sketch.
    """
    placed = (with_250m_cells(trips).withColumn("ingested", F.current_timestamp())
              .withWatermark("dropoff_datetime", EMPTY_LATENESS))
    around = F.window("dropoff_datetime", "30 minutes")
    no_time, no_fare, no_taxi = (F.lit(None).cast(t) for t in ("timestamp", "double", "string"))

    def at(end, fare, pickup, dropoff, ingested, taxi):
        return F.struct(F.col(f"{end}_cell_x").alias("cell_x"), F.col(f"{end}_cell_y").alias("cell_y"),
                        fare.alias("fare"), pickup.alias("pickup"), dropoff.alias("dropoff"),
                        ingested.alias("arrived"), taxi.alias("taxi"))

    known = [F.col(c) for c in ("fare_plus_tip", "pickup_datetime", "dropoff_datetime", "ingested")]
    both = F.array(at("start", *known, no_taxi), at("end", no_fare, no_time, no_time, no_time, F.col("medallion")))
    events = placed.select("dropoff_datetime", F.inline(both)).withColumn(
        "quarter", F.floor(F.unix_seconds("dropoff_datetime") / PROFIT_SECONDS) % 2)
    quarters = [F.col("quarter") == q for q in (0, 1)]
    taxis = F.size(F.collect_set("taxi")).cast("long") if exact else F.approx_count_distinct("taxi")
    summed = events.groupBy(around, "cell_x", "cell_y").agg(
        taxis.alias("empty_taxis"),
        *[m.alias(f"{name}_{q}") for q, now in enumerate(quarters) for name, m in {
            "fare": median_element(F.when(now, F.col("fare"))), "pickup": F.max(F.when(now, F.col("pickup"))),
            "dropoff": F.max(F.when(now, F.col("dropoff"))),
            "ingested": F.max(F.when(now, F.col("arrived")))}.items()])
    start = F.unix_seconds("window.start")
    rows = summed.select("cell_x", "cell_y", "empty_taxis", F.inline(F.array(*[
        F.struct(F.col(f"fare_{q}").alias("median_fare_tip"), F.col(f"pickup_{q}").alias("trigger_pickup"),
                 F.col(f"dropoff_{q}").alias("trigger_dropoff"), F.col(f"ingested_{q}").alias("ingested"),
                 (start + q * PROFIT_SECONDS).alias("window_start"),
                 (start + (q + 1) * PROFIT_SECONDS).alias("window_end")) for q in (0, 1)])))
    # a quarter without a pickup has no profit, a cell without a dropoff no taxi to share it
    shared = rows.filter(F.col("trigger_dropoff").isNotNull() & (F.col("empty_taxis") > 0))
    return shared.withColumn("profitability", profitability("median_fare_tip", "empty_taxis"))


def run_profit_changes(trips: DataFrame, path: str, checkpoint: str, k: int = TOP,
                       every: str | None = None) -> StreamingQuery:
    """A row when the ordered list of the k most profitable cells changes."""
    named = profitability_windows(trips).withColumn("cell", cell_name("cell_x", "cell_y"))
    order = [F.desc_nulls_last("profitability"), F.desc("median_fare_tip"), F.asc("cell")]
    return run_changes(
        named, order, k, F.col("cell"), True, PROFIT_COLUMNS, path, checkpoint, every
    )
