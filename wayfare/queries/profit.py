"""Profitable-area queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.operators.cleaning import clean_trips
from wayfare.plans import profit as plans
from wayfare.queries.base import CLEAN, TRIPS, cell_250m_x_sql, cell_250m_y_sql, ctes, placed_of, query
from wayfare.session import scratch_path
from wayfare.sources import derived

SIX_HOURS = 6 * 3600
PLACED = ctes(TRIPS, CLEAN, placed_of("clean"))


def _placed(spark, sf_dir):
    return plans.with_250m_cells(clean_trips(derived.trips(spark, sf_dir)))


def _ended(spark, sf_dir):
    return plans.with_end_cells(clean_trips(derived.trips(spark, sf_dir)))


def profit_sql(size: int, median: str) -> str:
    return f"""profit AS (
        SELECT dropoff_unix - dropoff_unix % {size} AS window_start, CAST(sx AS INT) AS cell_x,
            CAST(sy AS INT) AS cell_y, {median} AS median_fare_tip,
            max(pickup_unix) AS trigger_pickup, max(dropoff_unix) AS trigger_dropoff
        FROM placed GROUP BY 1, 2, 3)"""


ELEMENT = "quantile_disc(fare_plus_tip, 0.5)"


@query("profit_by_cell", PLACED + ", " + profit_sql(900, ELEMENT) + "SELECT * FROM profit")
def profit_by_cell(spark, sf_dir):
    return plans.profit_by_cell(_placed(spark, sf_dir))


@query("profit_by_cell_six_hours", PLACED + ", " + profit_sql(SIX_HOURS, ELEMENT)
       + "SELECT * FROM profit")
def profit_by_cell_six_hours(spark, sf_dir):
    return plans.profit_by_cell(_placed(spark, sf_dir), SIX_HOURS)


@query("exact_profit_by_cell", PLACED + ", " + profit_sql(900, "median(fare_plus_tip)") + """
    SELECT window_start, cell_x, cell_y, median_fare_tip FROM profit""")
def exact_profit_by_cell(spark, sf_dir):
    return plans.exact_profit_by_cell(_placed(spark, sf_dir))


@query("exact_profit_six_hours", PLACED + ", " + profit_sql(SIX_HOURS, "median(fare_plus_tip)") + """
    SELECT window_start, cell_x, cell_y, median_fare_tip FROM profit""")
def exact_profit_six_hours(spark, sf_dir):
    return plans.exact_profit_by_cell(_placed(spark, sf_dir), SIX_HOURS)


TAXIS = """taxis AS (
    SELECT dropoff_unix - dropoff_unix % 1800 AS window_start, CAST(ex AS INT) AS cell_x,
        CAST(ey AS INT) AS cell_y, count(DISTINCT medallion) AS empty_taxis
    FROM placed GROUP BY 1, 2, 3)"""


@query("empty_taxis_distinct", PLACED + f", {TAXIS} SELECT * FROM taxis")
def empty_taxis_distinct(spark, sf_dir):
    return plans.taxis_by_cell(_placed(spark, sf_dir))


@query("empty_taxis_approximate", PLACED + f", {TAXIS} SELECT *, true AS near FROM taxis")
def empty_taxis_approximate(spark, sf_dir):
    """Taxis of half hours from stored sketches of quarters, within three standard deviations of the exact number."""
    placed, stored = _placed(spark, sf_dir), scratch_path(spark, "sketches")
    plans.taxi_sketches(placed).write.parquet(stored)
    estimated = plans.taxis_from_sketches(spark.read.parquet(stored)).withColumnRenamed("empty_taxis", "estimate")
    both = plans.taxis_by_cell(placed).join(estimated, ["window_start", *plans.CELL], "full")
    bound = F.greatest(F.lit(0.5), 3 * plans.SKETCH_ERROR * F.col("empty_taxis"))
    near = F.abs(F.col("estimate") - F.col("empty_taxis")) <= bound
    return both.select("window_start", *plans.CELL, "empty_taxis", F.coalesce(near, F.lit(False)).alias("near"))


# the definition itself: the latest dropoff up to T, at most 30 minutes old, no pickup since
EMPTY = f"""ended AS (SELECT trip_id, medallion, pickup_unix, dropoff_unix,
        CASE WHEN ex BETWEEN 1 AND 600 AND ey BETWEEN 1 AND 600 THEN ex END AS ex, ey
        FROM (SELECT *, {cell_250m_x_sql("dropoff_latitude", "dropoff_longitude")} AS ex,
            {cell_250m_y_sql("dropoff_latitude")} AS ey FROM clean)),
    bounds AS (SELECT min(dropoff_unix) AS lo, max(dropoff_unix) AS hi FROM ended),
    ticks AS (SELECT unnest(range((lo // 900) * 900, hi + 2700, 900)) AS tick FROM bounds),
    latest AS (
        SELECT t.tick, d.medallion, d.dropoff_unix, d.ex, d.ey,
            row_number() OVER (PARTITION BY t.tick, d.medallion
                ORDER BY d.dropoff_unix DESC, d.trip_id DESC) AS n
        FROM ticks t JOIN ended d
        ON d.dropoff_unix <= t.tick AND d.dropoff_unix >= t.tick - 1800),
    empties AS (
        SELECT tick, CAST(ex AS INT) AS cell_x, CAST(ey AS INT) AS cell_y, count(*) AS empty_taxis
        FROM latest l WHERE n = 1 AND ex IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM ended p WHERE p.medallion = l.medallion
            AND p.pickup_unix > l.dropoff_unix AND p.pickup_unix <= l.tick)
        GROUP BY 1, 2, 3)"""


@query("empty_taxis", PLACED + f", {EMPTY} SELECT * FROM empties")
def empty_taxis(spark, sf_dir):
    return plans.empty_taxis(_ended(spark, sf_dir))


@query("profitability_by_window", PLACED + ", " + profit_sql(900, ELEMENT) + f""", {TAXIS}
    SELECT p.*, t.window_start AS empty_start, t.empty_taxis,
        p.median_fare_tip / t.empty_taxis AS profitability
    FROM profit p JOIN taxis t ON p.cell_x = t.cell_x AND p.cell_y = t.cell_y
    AND p.window_start - p.window_start % 1800 = t.window_start""")
def profitability_by_window(spark, sf_dir):
    return plans.profitability_by_window(_placed(spark, sf_dir))


AREAS = PLACED + ", " + profit_sql(900, ELEMENT) + f""", {EMPTY}, scored AS (
    SELECT p.window_start + 900 AS tick, p.cell_x, p.cell_y, p.median_fare_tip,
        coalesce(e.empty_taxis, 0) AS empty_taxis, p.trigger_pickup, p.trigger_dropoff,
        CASE WHEN e.empty_taxis > 0 THEN p.median_fare_tip / e.empty_taxis END AS profitability
    FROM profit p LEFT JOIN empties e
    ON e.tick = p.window_start + 900 AND e.cell_x = p.cell_x AND e.cell_y = p.cell_y),
    areas AS (SELECT * FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY tick ORDER BY profitability DESC NULLS LAST,
            median_fare_tip DESC, cell_x, cell_y) AS INT) AS rank FROM scored) WHERE rank <= 10)"""


@query("profitable_areas", AREAS + "SELECT * FROM areas")
def profitable_areas(spark, sf_dir):
    return plans.profitable_areas(_placed(spark, sf_dir), _ended(spark, sf_dir))


@query("profitable_areas_wide", AREAS + "SELECT tick, " + ", ".join(
    f"max(CASE WHEN rank = {i} THEN cell_x || '.' || cell_y END) AS profitable_cell_id_{i},"
    f" max(CASE WHEN rank = {i} THEN empty_taxis END) AS empty_taxies_in_cell_id_{i},"
    f" max(CASE WHEN rank = {i} THEN median_fare_tip END) AS median_profit_in_cell_id_{i},"
    f" max(CASE WHEN rank = {i} THEN profitability END) AS profitability_of_cell_{i}"
    for i in range(1, 11)) + " FROM areas GROUP BY tick")
def profitable_areas_wide(spark, sf_dir):
    return plans.profitable_areas_wide(plans.profitable_areas(_placed(spark, sf_dir), _ended(spark, sf_dir)))
