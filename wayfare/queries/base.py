"""The query registry and the SQL parts that several checks share."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.session import prepare
from wayfare.sources import derived

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, with its SQL check if there is one."""
    def register(make):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(make)
        def run(spark, sf_dir):
            return make(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register


# Sums of doubles differ in their last bits between engines. Both sides are put on a grid whose
# borders lie at an odd place, where sums of ordinary fractions do not fall.
GRID_SHIFT = 0.37


def stable(value, digits: int = 6) -> Column:
    """A double on a grid of 10^-digits, the same in every engine."""
    value = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(GRID_SHIFT)) / scale


def stable_sql(value: str, digits: int = 6) -> str:
    return f"floor(({value}) * 1e{digits} + {GRID_SHIFT}e0) / 1e{digits}"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


TRIPS = f"trips AS ({derived.trips_sql()})"
VALID = """valid AS (
    SELECT *, dropoff_unix - pickup_unix AS duration FROM trips
    WHERE dropoff_unix - pickup_unix BETWEEN 1 AND 14400)"""
ON_EARTH = """pickup_longitude BETWEEN -180 AND 180 AND dropoff_longitude BETWEEN -180 AND 180
    AND pickup_latitude BETWEEN -90 AND 90 AND dropoff_latitude BETWEEN -90 AND 90"""
CLEAN = f"""clean AS (
    SELECT * FROM trips WHERE medallion IS NOT NULL AND trip_distance > 0
    AND trip_time_in_secs > 0 AND {ON_EARTH}
    AND trip_distance / (trip_time_in_secs / 3600e0) < 100)"""
LOCATED = """located AS (
    SELECT * FROM trips WHERE pickup_longitude IS NOT NULL AND pickup_latitude IS NOT NULL
    AND dropoff_longitude IS NOT NULL AND dropoff_latitude IS NOT NULL
    AND trip_time_in_secs > 0 AND trip_distance > 0)"""


def _trunc(value: str) -> str:
    return f"CAST(trunc({value}) AS BIGINT)"


def cell_deg_sql(lat: str, lon: str) -> str:
    x = f"{_trunc(f'({lon} + 74.913585e0) / 0.0045e0')} + 1"
    y = f"{_trunc(f'(41.474937e0 - {lat}) / 0.0045e0')} + 1"
    return f"CAST({x} AS VARCHAR) || '.' || CAST({y} AS VARCHAR)"


def _limited(value: str, limit: int) -> str:
    return f"CASE WHEN {value} BETWEEN 1 AND {limit} THEN {value} END"


def cell_500m_x_sql(lat: str, lon: str) -> str:
    return _limited(
        "(" + _trunc(f"({lon} + 74.913585e0) * 111000 * cos(radians({lat})) / 500") + " + 1)", 300
    )


def cell_500m_y_sql(lat: str) -> str:
    return _limited("(" + _trunc(f"(41.474937e0 - {lat}) * 111000 / 500") + " + 1)", 300)


def cell_250m_x_sql(lat: str, lon: str) -> str:
    return ("(CAST(floor(6371000e0 * (radians(" + lon + ") - radians(-74.913585e0)) * "
            "cos((radians(" + lat + ") + radians(41.474937e0)) / 2e0) / 250e0) AS BIGINT) + 1)")


def cell_250m_y_sql(lat: str) -> str:
    return ("(CAST(floor(-(6371000e0 * (radians(" + lat + ") - radians(41.474937e0))) / 250e0)"
            " AS BIGINT) + 1)")


def routes_of(table: str, name: str = "routes") -> str:
    """The rows of a table with degree cells."""
    start = cell_deg_sql("pickup_latitude", "pickup_longitude")
    end = cell_deg_sql("dropoff_latitude", "dropoff_longitude")
    return f"{name} AS (SELECT *, {start} AS start_cell, {end} AS end_cell FROM {table})"


def placed_of(table: str, name: str = "placed") -> str:
    """The rows of a table inside the 250 m grid at both ends, with cell numbers."""
    sx = cell_250m_x_sql("pickup_latitude", "pickup_longitude")
    sy = cell_250m_y_sql("pickup_latitude")
    ex = cell_250m_x_sql("dropoff_latitude", "dropoff_longitude")
    ey = cell_250m_y_sql("dropoff_latitude")
    return f"""{name} AS (SELECT * FROM (
        SELECT *, {sx} AS sx, {sy} AS sy, {ex} AS ex, {ey} AS ey,
        fare_amount + tip_amount AS fare_plus_tip FROM {table})
        WHERE sx BETWEEN 1 AND 600 AND sy BETWEEN 1 AND 600
        AND ex BETWEEN 1 AND 600 AND ey BETWEEN 1 AND 600)"""


def boroughs_of(table: str, name: str = "placed", null_unknown: bool = True) -> str:
    """The rows of a table with pickup_borough and dropoff_borough, by counting crossings."""
    def hits(end: str) -> str:
        return f"""{end}_hits AS (
            SELECT trip_id, arg_min(borough, ordinal) AS borough FROM (
                SELECT t.trip_id, e.ordinal, min(e.borough) AS borough
                FROM {table} t JOIN edges e
                ON (e.y1 > t.{end}_latitude) <> (e.y2 > t.{end}_latitude)
                AND t.{end}_longitude < (e.x2 - e.x1) / (e.y2 - e.y1)
                    * (t.{end}_latitude - e.y1) + e.x1
                GROUP BY t.trip_id, e.ordinal HAVING count(*) % 2 = 1)
            GROUP BY trip_id)"""

    def name_of(end: str) -> str:
        found = f"coalesce({end}_hits.borough, 'Unknown')"
        if null_unknown:
            return found
        return f"CASE WHEN {end}_longitude IS NULL OR {end}_latitude IS NULL THEN NULL ELSE {found} END"

    return ",\n".join([
        f"edges AS ({derived.borough_edges_sql()})",
        hits("pickup"),
        hits("dropoff"),
        f"""{name} AS (SELECT t.*, {name_of('pickup')} AS pickup_borough,
            {name_of('dropoff')} AS dropoff_borough FROM {table} t
            LEFT JOIN pickup_hits ON t.trip_id = pickup_hits.trip_id
            LEFT JOIN dropoff_hits ON t.trip_id = dropoff_hits.trip_id)""",
    ])


ROUTES = f"edges AS ({derived.flight_routes_sql()})"
FLIGHTS = f"flights AS ({derived.flights_sql()})"
