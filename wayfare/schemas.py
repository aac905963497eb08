"""Table schemas as DDL text.

The column names and types are fixed values: they name the files and messages that
users already have, so they must not change.
"""

from __future__ import annotations

TRIP_MIN = """
    medallion string, pickup_datetime string, dropoff_datetime string,
    pickup_longitude double, pickup_latitude double,
    dropoff_longitude double, dropoff_latitude double
"""

TRIP_2013_SAMPLE = """
    medallion string, hack_license string, vendor_id string, rate_code string,
    store_and_fwd_flag string, pickup_datetime string, dropoff_datetime string,
    passenger_count int, pickup_longitude double, pickup_latitude double,
    dropoff_longitude double, dropoff_latitude double
"""

TRIP_2013_FULL = """
    medallion string, hack_license string, vendor_id string, rate_code string,
    store_and_fwd_flag string, pickup_datetime string, dropoff_datetime string,
    passenger_count int, trip_time_in_secs string, trip_distance string,
    pickup_longitude double, pickup_latitude double,
    dropoff_longitude double, dropoff_latitude double
"""

TRIP_2013_TYPED = """
    medallion string, hack_license string, vendor_id string, rate_code string,
    store_and_fwd_flag string, pickup_datetime timestamp, dropoff_datetime timestamp,
    passenger_count int, trip_time_in_secs int, trip_distance double,
    pickup_longitude double, pickup_latitude double,
    dropoff_longitude double, dropoff_latitude double
"""

TRIP_DEBS = """
    medallion string, hack_license string,
    pickup_datetime timestamp, dropoff_datetime timestamp,
    trip_time_in_secs int, trip_distance double,
    pickup_longitude double, pickup_latitude double,
    dropoff_longitude double, dropoff_latitude double,
    payment_type string, fare_amount double, surcharge double, mta_tax double,
    tip_amount double, tolls_amount double, total_amount double
"""

TRIP_INGEST = """
    medallion string, hack_license string,
    pickup_datetime timestamp, dropoff_datetime timestamp,
    trip_time_in_secs int, trip_distance double,
    pickup_longitude double, pickup_latitude double,
    dropoff_longitude double, dropoff_latitude double,
    payment_type string, fare_amount double, tip_amount double
"""

ENVELOPE = "key string, value string, timestamp timestamp"

FLIGHT = """
    FL_DATE date, OP_CARRIER string, OP_CARRIER_FL_NUM int, ORIGIN string, DEST string,
    CRS_DEP_TIME int, DEP_TIME double, DEP_DELAY double, TAXI_OUT double,
    WHEELS_OFF double, WHEELS_ON double, TAXI_IN double, CRS_ARR_TIME int,
    ARR_TIME double, ARR_DELAY double, CANCELLED double, CANCELLATION_CODE string,
    DIVERTED double, CRS_ELAPSED_TIME double, ACTUAL_ELAPSED_TIME double,
    AIR_TIME double, DISTANCE double, CARRIER_DELAY double, WEATHER_DELAY double,
    NAS_DELAY double, SECURITY_DELAY double, LATE_AIRCRAFT_DELAY double
"""


def column_names(ddl: str) -> list[str]:
    """The column names of a flat DDL schema, in order."""
    return [part.split()[0] for part in ddl.split(",")]


def route_change_schema(k: int = 10) -> str:
    """One change-feed row of the k most frequent routes."""
    cells = [f"start_cell_id_{i} string, end_cell_id_{i} string" for i in range(1, k + 1)]
    return ", ".join(
        ["pickup_datetime timestamp", "dropoff_datetime timestamp", *cells, "delay double"]
    )


def profit_change_schema(k: int = 10) -> str:
    """One change-feed row of the k most profitable cells."""
    cells = [
        f"profitable_cell_id_{i} string, empty_taxies_in_cell_id_{i} bigint, "
        f"median_profit_in_cell_id_{i} double, profitability_of_cell_{i} double"
        for i in range(1, k + 1)
    ]
    return ", ".join(
        ["pickup_datetime timestamp", "dropoff_datetime timestamp", *cells, "delay double"]
    )
