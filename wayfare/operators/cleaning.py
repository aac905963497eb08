"""Trip filters. Each works on batch and streaming DataFrames alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.measures import speed_mph

# Limits of a believable trip.
LONGEST_TRIP_SECONDS = 4 * 60 * 60
TOP_SPEED_MPH = 100

LONGITUDES = ("pickup_longitude", "dropoff_longitude")
LATITUDES = ("pickup_latitude", "dropoff_latitude")
COORDINATES = LONGITUDES + LATITUDES


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def on_earth() -> Column:
    return _all(
        [F.col(c).between(-180, 180) for c in LONGITUDES]
        + [F.col(c).between(-90, 90) for c in LATITUDES]
    )


def with_duration(df: DataFrame) -> DataFrame:
    return df.withColumn("duration", F.col("dropoff_unix") - F.col("pickup_unix"))


def valid_duration(df: DataFrame) -> DataFrame:
    """Trips that took 1 second to 4 hours, with their `duration`."""
    return with_duration(df).filter(F.col("duration").between(1, LONGEST_TRIP_SECONDS))


def clean_trips(df: DataFrame) -> DataFrame:
    """Trips of a known taxi with a way, a time, places on earth and a believable speed."""
    return df.filter(
        F.col("medallion").isNotNull()
        & (F.col("trip_distance") > 0)
        & (F.col("trip_time_in_secs") > 0)
        & on_earth()
        & (speed_mph() < TOP_SPEED_MPH)
    )


def clean_trips_strict(df: DataFrame) -> DataFrame:
    """As `clean_trips`, with passengers and non-zero places; fast trips are only flagged."""
    kept = df.filter(
        F.col("medallion").isNotNull()
        & (F.col("trip_distance") > 0)
        & (F.col("passenger_count") > 0)
        & (F.col("trip_time_in_secs") > 0)
        & _all([F.col(c) != 0 for c in COORDINATES])
        & on_earth()
    )
    return kept.withColumn("trip_speed_mph", speed_mph()).withColumn(
        "is_valid_trip", F.col("trip_speed_mph") < TOP_SPEED_MPH
    )


def located_trips(df: DataFrame) -> DataFrame:
    """Trips with all four coordinates, a time and a way."""
    return df.filter(
        _all([F.col(c).isNotNull() for c in COORDINATES])
        & (F.col("trip_time_in_secs") > 0)
        & (F.col("trip_distance") > 0)
    )


def in_grid(df: DataFrame, *cells: str) -> DataFrame:
    """Rows whose cell columns are all known."""
    return df.dropna(subset=list(cells))


def non_loops(df: DataFrame) -> DataFrame:
    return df.filter(F.col("start_cell") != F.col("end_cell"))


def null_and_nan_counts(df: DataFrame, columns) -> DataFrame:
    """One row with `{column}_nulls` and `{column}_nans`, counted in one pass."""
    return df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
        *[F.count_if(F.isnan(c)).alias(f"{c}_nans") for c in columns],
    )
