"""Trips, flights and boroughs derived from the star-schema test tables.

The expressions are written in the SQL that Spark and other engines share, so that a
check can build the same rows elsewhere. `{unix}` is the engine's "timestamp to epoch
seconds" call. All rows of the tables take part.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# trips from `events`: one trip per event
TRIP_EXPRESSIONS = {
    "trip_id": "event_id",
    "medallion": "CASE WHEN event_id % 101 = 0 THEN NULL"
                 " ELSE concat('M', lpad(CAST(user_id AS STRING), 6, '0')) END",
    "hack_license": "concat('H', lpad(CAST(user_id % 97 AS STRING), 4, '0'))",
    "pickup_unix": "{unix}",
    "dropoff_unix": "{unix} + CAST(floor(value * 60) AS BIGINT)",
    "trip_time_in_secs": "CAST(floor(value * 60) AS INT)",
    "trip_distance": "CASE WHEN event_id % 50 = 0 THEN value * 3 ELSE value / 5 END",
    "pickup_longitude": "CASE WHEN event_id % 103 = 0 THEN -200e0"
                        " WHEN event_id % 107 = 0 THEN 0e0"
                        " ELSE -73.9999e0 + 0.0045e0 * (event_id % 3) END",
    "pickup_latitude": "40.7001e0 + 0.0045e0 * (event_id % 5)",
    "dropoff_longitude": "CASE WHEN event_id % 109 = 0 THEN NULL"
                         " ELSE -73.9999e0 + 0.0045e0 * (user_id % 4) END",
    "dropoff_latitude": "40.7001e0 + 0.0045e0 * (user_id % 5)",
    "passenger_count": "CAST(event_id % 7 AS INT)",
    "payment_type": "CASE WHEN event_id % 2 = 0 THEN 'CRD' ELSE 'CSH' END",
    "fare_amount": "value + 2.5e0",
    "surcharge": "0.5e0",
    "mta_tax": "0.5e0",
    "tip_amount": "0.75e0 * (event_id % 5)",
    "tolls_amount": "0e0",
    "total_amount": "value + 3.5e0 + 0.75e0 * (event_id % 5)",
}

# flights of the network from `lineitem`: one flight per line
ROUTE_EXPRESSIONS = {
    "src": "concat('A', lpad(CAST(l_suppkey AS STRING), 8, '0'))",
    "dst": "concat('A', lpad(CAST(l_partkey AS STRING), 8, '0'))",
}

_CANCELLED = (
    "((l_returnflag = 'R' AND l_discount >= 0.05)"
    " OR (l_quantity > 45 AND l_suppkey % 60 < 20))"
)

# the flight table from `lineitem`: one flight per line, with gaps as in real files
FLIGHT_EXPRESSIONS = {
    "FL_DATE": "CAST(l_shipdate AS DATE)",
    "OP_CARRIER": "concat('C', CAST(l_linenumber AS STRING))",
    "OP_CARRIER_FL_NUM": "CAST(l_orderkey % 9000 AS INT)",
    "ORIGIN": "concat('A', lpad(CAST(l_suppkey % 60 AS STRING), 3, '0'))",
    "DEST": "concat('A', lpad(CAST((l_partkey * 7) % 60 AS STRING), 3, '0'))",
    "CRS_DEP_TIME": "CAST((l_orderkey * 37) % 2400 AS INT)",
    "DEP_TIME": f"CASE WHEN {_CANCELLED} THEN NULL"
                " ELSE CAST((l_orderkey * 37 + 5) % 2400 AS DOUBLE) END",
    "DEP_DELAY": f"CASE WHEN {_CANCELLED} THEN NULL ELSE CAST(floor(l_tax * 1000) - 40 AS DOUBLE) END",
    "TAXI_OUT": f"CASE WHEN {_CANCELLED} THEN NULL ELSE l_quantity / 2 END",
    "WHEELS_OFF": f"CASE WHEN {_CANCELLED} THEN NULL"
                  " ELSE CAST((l_orderkey * 37 + 20) % 2400 AS DOUBLE) END",
    "WHEELS_ON": f"CASE WHEN {_CANCELLED} THEN NULL"
                 " ELSE CAST((l_orderkey * 37 + 200) % 2400 AS DOUBLE) END",
    "TAXI_IN": f"CASE WHEN {_CANCELLED} OR l_linenumber = 3 THEN NULL ELSE l_quantity / 4 END",
    "CRS_ARR_TIME": "CAST((l_orderkey * 37 + 210) % 2400 AS INT)",
    "ARR_TIME": f"CASE WHEN {_CANCELLED} THEN NULL"
                " ELSE CAST((l_orderkey * 37 + 215) % 2400 AS DOUBLE) END",
    "ARR_DELAY": f"CASE WHEN {_CANCELLED} THEN NULL ELSE CAST(floor(l_tax * 1000) - 30 AS DOUBLE) END",
    "CANCELLED": f"CASE WHEN {_CANCELLED} THEN 1e0 ELSE 0e0 END",
    "CANCELLATION_CODE": f"CASE WHEN {_CANCELLED} THEN substr('ABCD', CAST(l_suppkey % 4 AS INT) + 1, 1)"
                         " ELSE NULL END",
    "DIVERTED": "CASE WHEN l_linenumber = 7 AND l_tax >= 0.08 THEN 1e0"
                " WHEN l_orderkey % 997 = 0 THEN NULL ELSE 0e0 END",
    "CRS_ELAPSED_TIME": "CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE l_quantity * 6 END",
    "ACTUAL_ELAPSED_TIME": f"CASE WHEN {_CANCELLED} THEN NULL ELSE l_quantity * 6 + 3 END",
    "AIR_TIME": f"CASE WHEN {_CANCELLED} THEN NULL ELSE l_quantity * 5 END",
    "DISTANCE": "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(floor(l_extendedprice / 50) AS DOUBLE) END",
    "CARRIER_DELAY": "CASE WHEN l_linenumber > 2 THEN NULL ELSE CAST(floor(l_tax * 100) AS DOUBLE) END",
    "WEATHER_DELAY": "CASE WHEN l_linenumber > 2 THEN NULL ELSE 0e0 END",
    "NAS_DELAY": "CASE WHEN l_linenumber > 2 THEN NULL ELSE l_quantity END",
    "SECURITY_DELAY": "CAST(NULL AS DOUBLE)",
    "LATE_AIRCRAFT_DELAY": "CASE WHEN l_linenumber > 1 THEN NULL ELSE 1e0 END",
}

# Three shapes and a far one; the second name has two features, the third has a hole.
BOROUGH_FEATURES = [
    ("Northside", [[(-74.002, 40.712), (-73.997, 40.712), (-73.997, 40.7205), (-74.002, 40.7205)]]),
    ("Twinfield", [[(-73.997, 40.698), (-73.993, 40.698), (-73.993, 40.7025), (-73.997, 40.7025)]]),
    ("Ringwood", [[(-73.9995, 40.703), (-73.985, 40.703), (-73.985, 40.7115), (-73.9935, 40.7115),
                   (-73.9935, 40.7075), (-73.9995, 40.7075)],
                  [(-73.9925, 40.7035), (-73.9895, 40.7035), (-73.9895, 40.7055),
                   (-73.9925, 40.7055)]]),
    ("Twinfield", [[(-73.988, 40.698), (-73.985, 40.698), (-73.985, 40.7175), (-73.988, 40.7175)]]),
    ("Faraway", [[(10.0, 50.0), (11.0, 50.0), (11.0, 51.0), (10.0, 51.0)]]),
]

UNIX_SPARK = "unix_seconds(CAST(ts AS TIMESTAMP))"


def _named(expressions: dict[str, str], **parts) -> list[str]:
    return [f"{e.format(**parts)} AS {name}" for name, e in expressions.items()]


def trips_from(events: DataFrame) -> DataFrame:
    """Trips from an events table or stream, with their times as timestamps, too."""
    return events.selectExpr(*_named(TRIP_EXPRESSIONS, unix=UNIX_SPARK)).select(
        "*",
        F.timestamp_seconds("pickup_unix").alias("pickup_datetime"),
        F.timestamp_seconds("dropoff_unix").alias("dropoff_datetime"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from(spark.read.parquet(f"{sf_dir}/events.parquet"))


EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string"
)


def trip_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The same trips as a stream over the events files."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return trips_from(reader.parquet(f"{sf_dir}/events.parq*"))


def flight_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), one row per flight."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.selectExpr(*_named(ROUTE_EXPRESSIONS))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 27-column flight table."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.selectExpr(*_named(FLIGHT_EXPRESSIONS))


def borough_geojson() -> str:
    """The borough features as GeoJSON text, single rings as Polygon, others as MultiPolygon."""
    features = []
    for i, (name, rings) in enumerate(BOROUGH_FEATURES):
        closed = [[list(p) for p in ring + ring[:1]] for ring in rings]
        geometry = (
            {"type": "Polygon", "coordinates": closed}
            if i % 2 == 0
            else {"type": "MultiPolygon", "coordinates": [closed]}
        )
        features.append(
            {"type": "Feature", "properties": {"borough": name}, "geometry": geometry}
        )
    return json.dumps({"type": "FeatureCollection", "features": features})


def borough_edge_rows() -> list[tuple]:
    """(ordinal, borough, x1, y1, x2, y2) of every ring edge."""
    return [
        (i, name, *a, *b)
        for i, (name, rings) in enumerate(BOROUGH_FEATURES)
        for ring in rings
        for a, b in zip(ring, ring[1:] + ring[:1])
    ]


def borough_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        borough_edge_rows(),
        "ordinal int, borough string, x1 double, y1 double, x2 double, y2 double",
    )


# -- the same rows as SQL text for another engine -----------------------------------------

UNIX_SQL = "CAST(floor(epoch(ts)) AS BIGINT)"


def trips_sql() -> str:
    return f"SELECT {', '.join(_named(TRIP_EXPRESSIONS, unix=UNIX_SQL))} FROM events"


def flight_routes_sql() -> str:
    return f"SELECT {', '.join(_named(ROUTE_EXPRESSIONS))} FROM lineitem"


def flights_sql() -> str:
    return f"SELECT {', '.join(_named(FLIGHT_EXPRESSIONS))} FROM lineitem"


def borough_edges_sql() -> str:
    rows = ", ".join(
        f"({o}, '{b}', {x1}e0, {y1}e0, {x2}e0, {y2}e0)"
        for o, b, x1, y1, x2, y2 in borough_edge_rows()
    )
    return f"SELECT * FROM (VALUES {rows}) AS e(ordinal, borough, x1, y1, x2, y2)"
