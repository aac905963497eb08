"""Utilization, time to the next fare and flows between boroughs.

Trips carry pickup_unix and dropoff_unix (epoch seconds) and a trip_id, which settles
the order of trips that start or end at the same second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.measures import share
from wayfare.functions.times import hours, minutes, parse_unix
from wayfare.operators.cleaning import LONGEST_TRIP_SECONDS, valid_duration
from wayfare.operators.profiling import numeric_columns, summary
from wayfare.operators.sequence import next_value, previous_value
from wayfare.operators.skew import GROUP_ROWS

PICKUP_ORDER = ("pickup_unix", "dropoff_unix", "trip_id")
DROPOFF_ORDER = ("dropoff_unix", "pickup_unix", "trip_id")


def with_unix_times(df: DataFrame, formats=None) -> DataFrame:
    """Epoch seconds of trips whose times are text."""
    args = (formats,) if formats else ()
    return df.withColumns(
        {
            "pickup_unix": parse_unix("pickup_datetime", *args),
            "dropoff_unix": parse_unix("dropoff_datetime", *args),
        }
    )


def with_idle_time(df: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Valid trips with `idle_time`: seconds since the taxi's previous dropoff.

    It is 0 for a taxi's first trip and for a gap of more than four hours (off duty).
    Overlapping trips give a negative gap, which is kept.
    """
    valid = valid_duration(df)
    linked = previous_value(
        valid, ["medallion"], PICKUP_ORDER, "dropoff_unix", "prev_dropoff_unix", limit
    )
    gap = F.col("pickup_unix") - F.col("prev_dropoff_unix")
    return linked.withColumn(
        "idle_time", F.when(gap <= LONGEST_TRIP_SECONDS, gap).otherwise(F.lit(0))
    )


def taxi_utilization(df: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Per taxi: seconds with passengers, seconds between them, and the share of the first."""
    totals = with_idle_time(df, limit).groupBy("medallion").agg(
        F.sum("duration").alias("total_trip_time"),
        F.sum("idle_time").alias("total_idle_time"),
    )
    return totals.withColumn("utilization_rate", share("total_trip_time", "total_idle_time"))


def with_units(utilization: DataFrame) -> DataFrame:
    return utilization.withColumns(
        {
            "trip_time_hours": hours("total_trip_time"),
            "idle_time_hours": hours("total_idle_time"),
            "idle_time_minutes": minutes("total_idle_time"),
            "trip_time_minutes": minutes("total_trip_time"),
        }
    )


def utilization_summary(utilization: DataFrame) -> DataFrame:
    """Count, mean, spread and quartiles of every numeric column."""
    units = with_units(utilization)
    return summary(units, numeric_columns(units))


def _next_pickup(df: DataFrame, limit: int) -> DataFrame:
    return next_value(
        df, ["hack_license"], PICKUP_ORDER, "pickup_unix", "next_pickup_unix", limit
    )


def driver_utilization(
    df: DataFrame, limit: int = GROUP_ROWS, digits: int | None = 4
) -> DataFrame:
    """Per driver, in milliseconds: time on trips, idle time to the next pickup, and the share.

    A driver's last trip has no idle time. digits=None leaves the share unrounded.
    """
    timed = _next_pickup(df, limit).select(
        "hack_license",
        ((F.col("dropoff_unix") - F.col("pickup_unix")) * 1000).alias("trip_duration_ms"),
        F.coalesce(
            (F.col("next_pickup_unix") - F.col("dropoff_unix")) * 1000, F.lit(0)
        ).alias("idle_time_ms"),
    )
    totals = timed.groupBy("hack_license").agg(
        F.sum("trip_duration_ms").alias("total_trip_duration_ms"),
        F.sum("idle_time_ms").alias("total_idle_time_ms"),
    )
    rate = share("total_trip_duration_ms", "total_idle_time_ms")
    return totals.withColumn(
        "utilization_rate", rate if digits is None else F.round(rate, digits)
    )


def with_time_to_next_fare(df: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Valid trips with seconds until the taxi's next pickup, NULL if that came earlier."""
    linked = next_value(
        valid_duration(df), ["medallion"], DROPOFF_ORDER, "pickup_unix", "next_pickup_unix", limit
    )
    gap = F.col("next_pickup_unix") - F.col("dropoff_unix")
    return linked.withColumn("time_to_next_fare", F.when(gap >= 0, gap))


def next_fare_by_borough(df: DataFrame, boroughs, limit: int = GROUP_ROWS) -> DataFrame:
    """Mean seconds to the next fare by the borough of the dropoff."""
    waited = with_time_to_next_fare(df, limit).filter(F.col("time_to_next_fare").isNotNull())
    placed = boroughs.lookup(waited, "dropoff_longitude", "dropoff_latitude", "dropoff_borough")
    return placed.groupBy("dropoff_borough").agg(
        F.avg("time_to_next_fare").alias("avg_time_to_next_fare")
    )


def borough_idle(df: DataFrame, boroughs, limit: int = GROUP_ROWS,
                 digits: int | None = 2) -> DataFrame:
    """Mean idle time to the driver's next pickup, and trips, by the borough of the dropoff."""
    linked = _next_pickup(df, limit).filter(F.col("next_pickup_unix").isNotNull())
    placed = boroughs.lookup(
        linked, "dropoff_longitude", "dropoff_latitude", "dropoff_borough", null_is_unknown=False
    )
    idle = (F.col("next_pickup_unix") - F.col("dropoff_unix")) * 1000
    minutes_idle = F.col("avg_idle_time_ms") / 60000
    return (
        placed.groupBy("dropoff_borough")
        .agg(F.avg(idle).alias("avg_idle_time_ms"), F.count(F.lit(1)).alias("trip_count"))
        .withColumn(
            "avg_idle_time_minutes",
            minutes_idle if digits is None else F.round(minutes_idle, digits),
        )
    )


def same_borough(placed: DataFrame) -> DataFrame:
    """Trips within a borough that name their taxi. "Unknown" counts as a borough."""
    return (
        placed.filter(F.col("pickup_borough") == F.col("dropoff_borough"))
        .groupBy("pickup_borough")
        .agg(F.count("medallion").alias("same_borough_trips"))
    )


def same_borough_all(placed: DataFrame) -> DataFrame:
    """Trips within a borough, with or without a taxi."""
    return (
        placed.filter(F.col("pickup_borough") == F.col("dropoff_borough"))
        .groupBy("pickup_borough")
        .agg(F.count(F.lit(1)).alias("same_borough_trip_count"))
    )


def cross_borough(placed: DataFrame) -> DataFrame:
    """Trips between boroughs, most frequent pair first."""
    return (
        placed.filter(F.col("pickup_borough") != F.col("dropoff_borough"))
        .groupBy("pickup_borough", "dropoff_borough")
        .agg(F.count("medallion").alias("cross_borough_trips"))
        .orderBy(F.desc("cross_borough_trips"), "pickup_borough", "dropoff_borough")
    )


def inter_borough_total(placed: DataFrame) -> DataFrame:
    """The number of trips between different boroughs."""
    return placed.filter(F.col("pickup_borough") != F.col("dropoff_borough")).agg(
        F.count(F.lit(1)).alias("inter_borough_trips")
    )
