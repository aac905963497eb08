"""Utilization, next fare and borough queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.operators.places import Boroughs
from wayfare.plans import trips as plans
from wayfare.queries.base import (
    TRIPS,
    VALID,
    boroughs_of,
    ctes,
    query,
    stable,
    stable_sql,
)
from wayfare.sources import derived

LINKED = """linked AS (
    SELECT *, lag(dropoff_unix) OVER (
        PARTITION BY medallion ORDER BY pickup_unix, dropoff_unix, trip_id) AS prev_dropoff_unix
    FROM valid)"""
IDLE = """idle AS (
    SELECT *, CASE WHEN pickup_unix - prev_dropoff_unix <= 14400
        THEN pickup_unix - prev_dropoff_unix ELSE 0 END AS idle_time
    FROM linked)"""
UTILIZATION = """utilization AS (
    SELECT medallion, CAST(sum(duration) AS BIGINT) AS total_trip_time,
        CAST(sum(idle_time) AS BIGINT) AS total_idle_time,
        CAST(sum(duration) AS DOUBLE) / CAST(sum(duration) + sum(idle_time) AS DOUBLE)
            AS utilization_rate
    FROM idle GROUP BY medallion)"""
NEXT_FARE = """waits AS (
    SELECT * FROM (SELECT *, lead(pickup_unix) OVER (
        PARTITION BY medallion ORDER BY dropoff_unix, pickup_unix, trip_id) AS next_pickup_unix
        FROM valid))"""
DRIVER = """driver AS (
    SELECT *, lead(pickup_unix) OVER (
        PARTITION BY hack_license ORDER BY pickup_unix, dropoff_unix, trip_id) AS next_pickup_unix
    FROM trips)"""


def _boroughs(spark):
    return Boroughs(derived.borough_edges(spark))


@query("taxi_utilization", ctes(TRIPS, VALID, LINKED, IDLE, UTILIZATION) + "SELECT * FROM utilization")
def taxi_utilization(spark, sf_dir):
    return plans.taxi_utilization(derived.trips(spark, sf_dir))


@query("idle_times", ctes(TRIPS, VALID, LINKED, IDLE) + """
    SELECT trip_id, medallion, duration, prev_dropoff_unix, idle_time FROM idle""")
def idle_times(spark, sf_dir):
    return plans.with_idle_time(derived.trips(spark, sf_dir)).select(
        "trip_id", "medallion", "duration", "prev_dropoff_unix", "idle_time"
    )


@query("driver_utilization", ctes(TRIPS, DRIVER) + """
    SELECT hack_license, CAST(sum(d) AS BIGINT) AS total_trip_duration_ms,
        CAST(sum(i) AS BIGINT) AS total_idle_time_ms,
        CAST(sum(d) AS DOUBLE) / CAST(sum(d) + sum(i) AS DOUBLE) AS utilization_rate
    FROM (SELECT hack_license, (dropoff_unix - pickup_unix) * 1000 AS d,
        coalesce((next_pickup_unix - dropoff_unix) * 1000, 0) AS i FROM driver)
    GROUP BY hack_license""")
def driver_utilization(spark, sf_dir):
    return plans.driver_utilization(derived.trips(spark, sf_dir), digits=None)


@query("driver_next_pickup", ctes(TRIPS, DRIVER) + """
    SELECT trip_id, hack_license, next_pickup_unix,
        (next_pickup_unix - dropoff_unix) * 1000 AS idle_time_ms FROM driver""")
def driver_next_pickup(spark, sf_dir):
    linked = plans._next_pickup(derived.trips(spark, sf_dir), plans.GROUP_ROWS)
    return linked.select(
        "trip_id", "hack_license", "next_pickup_unix",
        ((F.col("next_pickup_unix") - F.col("dropoff_unix")) * 1000).alias("idle_time_ms"),
    )


_UNITS = ["total_trip_time", "total_idle_time", "utilization_rate", "trip_time_hours",
          "idle_time_hours", "idle_time_minutes", "trip_time_minutes"]
UNITS = """units AS (
    SELECT medallion, total_trip_time, total_idle_time, utilization_rate,
        total_trip_time / 3600e0 AS trip_time_hours, total_idle_time / 3600e0 AS idle_time_hours,
        total_idle_time / 60e0 AS idle_time_minutes, total_trip_time / 60e0 AS trip_time_minutes
    FROM utilization)"""


@query("utilization_units", ctes(TRIPS, VALID, LINKED, IDLE, UTILIZATION, UNITS) + "SELECT * FROM units")
def utilization_units(spark, sf_dir):
    return plans.with_units(plans.taxi_utilization(derived.trips(spark, sf_dir)))


def _statistic(label: str, call: str) -> str:
    columns = ", ".join(
        f"{stable_sql(f'CAST({call.format(c)} AS DOUBLE)')} AS {c}" for c in _UNITS
    )
    return f"SELECT '{label}' AS statistic, {columns} FROM units"


@query("utilization_summary", ctes(TRIPS, VALID, LINKED, IDLE, UTILIZATION, UNITS) + " UNION ALL ".join([
    _statistic("count", "count({0})"), _statistic("mean", "avg({0})"),
    _statistic("stddev", "stddev_samp({0})"), _statistic("min", "min({0})"),
    _statistic("25%", "quantile_disc({0}, 0.25)"), _statistic("50%", "quantile_disc({0}, 0.5)"),
    _statistic("75%", "quantile_disc({0}, 0.75)"), _statistic("max", "max({0})")]))
def utilization_summary(spark, sf_dir):
    table = plans.utilization_summary(plans.taxi_utilization(derived.trips(spark, sf_dir)))
    return table.select("statistic", *[stable(c).alias(c) for c in _UNITS])


@query("trip_boroughs", ctes(TRIPS, boroughs_of("trips")) + """
    SELECT trip_id, pickup_borough, dropoff_borough FROM placed""")
def trip_boroughs(spark, sf_dir):
    placed = _boroughs(spark).both_ends(derived.trips(spark, sf_dir))
    return placed.select("trip_id", "pickup_borough", "dropoff_borough")


@query("trip_boroughs_null", ctes(TRIPS, boroughs_of("trips", null_unknown=False)) + """
    SELECT trip_id, pickup_borough, dropoff_borough FROM placed""")
def trip_boroughs_null(spark, sf_dir):
    placed = _boroughs(spark).both_ends(derived.trips(spark, sf_dir), null_is_unknown=False)
    return placed.select("trip_id", "pickup_borough", "dropoff_borough")


@query("trip_boroughs_by_shuffle", ctes(TRIPS, boroughs_of("trips")) + """
    SELECT trip_id, pickup_borough, dropoff_borough FROM placed""")
def trip_boroughs_by_shuffle(spark, sf_dir):
    """The way taken for polygon sets that are too large to broadcast."""
    large = Boroughs(derived.borough_edges(spark), broadcast_edges=0)
    return large.both_ends(derived.trips(spark, sf_dir)).select(
        "trip_id", "pickup_borough", "dropoff_borough"
    )


@query("time_to_next_fare", ctes(TRIPS, VALID, NEXT_FARE) + """
    SELECT trip_id, medallion, CASE WHEN next_pickup_unix >= dropoff_unix
        THEN next_pickup_unix - dropoff_unix END AS time_to_next_fare FROM waits""")
def time_to_next_fare(spark, sf_dir):
    return plans.with_time_to_next_fare(derived.trips(spark, sf_dir)).select(
        "trip_id", "medallion", "time_to_next_fare"
    )


@query("next_fare_by_borough", ctes(TRIPS, VALID, NEXT_FARE, boroughs_of("waits")) + """
    SELECT dropoff_borough, avg(next_pickup_unix - dropoff_unix) AS avg_time_to_next_fare
    FROM placed WHERE next_pickup_unix >= dropoff_unix GROUP BY dropoff_borough""")
def next_fare_by_borough(spark, sf_dir):
    return plans.next_fare_by_borough(derived.trips(spark, sf_dir), _boroughs(spark))


@query("borough_idle", ctes(TRIPS, DRIVER, boroughs_of("driver", null_unknown=False)) + """
    SELECT dropoff_borough, avg((next_pickup_unix - dropoff_unix) * 1000) AS avg_idle_time_ms,
        count(*) AS trip_count,
        avg((next_pickup_unix - dropoff_unix) * 1000) / 60000 AS avg_idle_time_minutes
    FROM placed WHERE next_pickup_unix IS NOT NULL GROUP BY dropoff_borough""")
def borough_idle(spark, sf_dir):
    return plans.borough_idle(derived.trips(spark, sf_dir), _boroughs(spark), digits=None)


def _valid_placed(spark, sf_dir):
    return _boroughs(spark).both_ends(plans.valid_duration(derived.trips(spark, sf_dir)))


PLACED = ctes(TRIPS, VALID, boroughs_of("valid"))


@query("same_borough", PLACED + """
    SELECT pickup_borough, count(medallion) AS same_borough_trips FROM placed
    WHERE pickup_borough = dropoff_borough GROUP BY pickup_borough""")
def same_borough(spark, sf_dir):
    return plans.same_borough(_valid_placed(spark, sf_dir))


@query("same_borough_all", PLACED + """
    SELECT pickup_borough, count(*) AS same_borough_trip_count FROM placed
    WHERE pickup_borough = dropoff_borough GROUP BY pickup_borough""")
def same_borough_all(spark, sf_dir):
    return plans.same_borough_all(_valid_placed(spark, sf_dir))


@query("cross_borough", PLACED + """
    SELECT pickup_borough, dropoff_borough, count(medallion) AS cross_borough_trips FROM placed
    WHERE pickup_borough <> dropoff_borough GROUP BY pickup_borough, dropoff_borough""")
def cross_borough(spark, sf_dir):
    return plans.cross_borough(_valid_placed(spark, sf_dir))


@query("inter_borough_total", PLACED + """
    SELECT count(*) AS inter_borough_trips FROM placed WHERE pickup_borough <> dropoff_borough""")
def inter_borough_total(spark, sf_dir):
    return plans.inter_borough_total(_valid_placed(spark, sf_dir))


@query("taxi_totals", ctes(TRIPS, VALID, LINKED, IDLE) + """
    SELECT medallion, CAST(sum(duration) AS BIGINT) AS total_trip_time,
        CAST(sum(idle_time) AS BIGINT) AS total_idle_time FROM idle GROUP BY medallion""")
def taxi_totals(spark, sf_dir):
    """The same totals when a low limit makes every busy taxi a sliced one."""
    return plans.taxi_utilization(derived.trips(spark, sf_dir), limit=20).drop("utilization_rate")
