"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions.cells import cell_500m, cell_250m, cell_deg, cell_name
from wayfare.functions.measures import speed_mph
from wayfare.functions.registered import register_borough_function, register_cell_function
from wayfare.functions.times import hours, minutes, parse_timestamp, parse_unix
from wayfare.operators.cleaning import (
    COORDINATES,
    clean_trips,
    clean_trips_strict,
    in_grid,
    located_trips,
    null_and_nan_counts,
    valid_duration,
)
from wayfare.operators.profiling import existing, numeric_columns
from wayfare.plans.routes import with_500m_cells
from wayfare.queries.base import (
    CLEAN,
    LOCATED,
    ON_EARTH,
    TRIPS,
    VALID,
    boroughs_of,
    cell_250m_x_sql,
    cell_250m_y_sql,
    cell_500m_x_sql,
    cell_500m_y_sql,
    cell_deg_sql,
    ctes,
    query,
)
from wayfare.schemas import TRIP_MIN, column_names
from wayfare.sources import derived


@query("trip_projection", ctes(TRIPS) + """
    SELECT trip_id, medallion AS taxi, fare_amount + tip_amount AS paid,
        dropoff_unix - pickup_unix AS seconds FROM trips""")
def trip_projection(spark, sf_dir):
    return derived.trips(spark, sf_dir).select(
        "trip_id",
        F.col("medallion").alias("taxi"),
        (F.col("fare_amount") + F.col("tip_amount")).alias("paid"),
        (F.col("dropoff_unix") - F.col("pickup_unix")).alias("seconds"),
    )


@query("dropped_columns", ctes(TRIPS) + """
    SELECT * EXCLUDE (hack_license, payment_type, surcharge, mta_tax, tolls_amount, total_amount,
        passenger_count) FROM trips""")
def dropped_columns(spark, sf_dir):
    return derived.trips(spark, sf_dir).drop(
        "hack_license", "payment_type", "surcharge", "mta_tax", "tolls_amount", "total_amount",
        "passenger_count", "pickup_datetime", "dropoff_datetime",
    )


@query("renamed_aggregate", ctes(TRIPS) + """
    SELECT payment_type, count(*) AS trip_count FROM trips GROUP BY payment_type""")
def renamed_aggregate(spark, sf_dir):
    counted = derived.trips(spark, sf_dir).groupBy("payment_type").count()
    return counted.withColumnRenamed("count", "trip_count")


@query("trip_units", ctes(TRIPS) + """
    SELECT trip_id, trip_time_in_secs / 3600e0 AS trip_hours,
        trip_time_in_secs / 60e0 AS trip_minutes FROM trips""")
def trip_units(spark, sf_dir):
    return derived.trips(spark, sf_dir).select(
        "trip_id",
        hours("trip_time_in_secs").alias("trip_hours"),
        minutes("trip_time_in_secs").alias("trip_minutes"),
    )


@query("numeric_columns", ctes(TRIPS) + """
    SELECT * EXCLUDE (medallion, hack_license, payment_type) FROM trips""")
def numeric_only(spark, sf_dir):
    trips = derived.trips(spark, sf_dir)
    return trips.select(numeric_columns(trips))


@query("existing_columns", ctes(TRIPS) + """
    SELECT trip_id, medallion, fare_amount FROM trips""")
def existing_columns(spark, sf_dir):
    trips = derived.trips(spark, sf_dir)
    return trips.select(existing(trips, ["trip_id", "medallion", "fare_amount", "probability"]))


@query("window_fields", ctes(TRIPS) + """
    SELECT dropoff_unix - dropoff_unix % 1800 AS window_start,
        dropoff_unix - dropoff_unix % 1800 + 1800 AS window_end, count(*) AS trips
    FROM trips GROUP BY 1, 2""")
def window_fields(spark, sf_dir):
    windows = derived.trips(spark, sf_dir).groupBy(F.window("dropoff_datetime", "30 minutes"))
    return windows.agg(F.count(F.lit(1)).alias("trips")).select(
        F.unix_seconds("window.start").alias("window_start"),
        F.unix_seconds("window.end").alias("window_end"),
        "trips",
    )


@query("sliding_windows", ctes(TRIPS) + """
    SELECT w AS window_start, count(*) AS trips FROM (
        SELECT unnest(range(dropoff_unix - dropoff_unix % 300 - 1500,
            dropoff_unix - dropoff_unix % 300 + 1, 300)) AS w FROM trips) GROUP BY w""")
def sliding_windows(spark, sf_dir):
    """Half-hour windows that start every five minutes."""
    windows = derived.trips(spark, sf_dir).groupBy(
        F.window("dropoff_datetime", "30 minutes", "5 minutes")
    )
    return windows.agg(F.count(F.lit(1)).alias("trips")).select(
        F.unix_seconds("window.start").alias("window_start"), "trips"
    )


# -- filters ------------------------------------------------------------------------------


@query("valid_durations", ctes(TRIPS, VALID) + "SELECT trip_id, duration FROM valid")
def valid_durations(spark, sf_dir):
    return valid_duration(derived.trips(spark, sf_dir)).select("trip_id", "duration")


@query("clean_trips", ctes(TRIPS, CLEAN) + "SELECT * FROM clean")
def clean(spark, sf_dir):
    return clean_trips(derived.trips(spark, sf_dir)).drop("pickup_datetime", "dropoff_datetime")


@query("clean_trips_strict", ctes(TRIPS) + f"""
    SELECT trip_id, medallion, trip_distance / (trip_time_in_secs / 3600e0) AS trip_speed_mph,
        trip_distance / (trip_time_in_secs / 3600e0) < 100 AS is_valid_trip
    FROM trips WHERE medallion IS NOT NULL AND trip_distance > 0 AND passenger_count > 0
    AND trip_time_in_secs > 0 AND pickup_longitude <> 0 AND pickup_latitude <> 0
    AND dropoff_longitude <> 0 AND dropoff_latitude <> 0 AND {ON_EARTH}""")
def clean_strict(spark, sf_dir):
    return clean_trips_strict(derived.trips(spark, sf_dir)).select(
        "trip_id", "medallion", "trip_speed_mph", "is_valid_trip"
    )


@query("located_trips", ctes(TRIPS, LOCATED) + "SELECT trip_id FROM located")
def located(spark, sf_dir):
    return located_trips(derived.trips(spark, sf_dir)).select("trip_id")


@query("trips_in_grid", ctes(TRIPS) + f"""
    SELECT trip_id FROM trips WHERE
    {cell_500m_x_sql('pickup_latitude', 'pickup_longitude')} IS NOT NULL
    AND {cell_500m_y_sql('pickup_latitude')} IS NOT NULL
    AND {cell_500m_x_sql('dropoff_latitude', 'dropoff_longitude')} IS NOT NULL
    AND {cell_500m_y_sql('dropoff_latitude')} IS NOT NULL""")
def trips_in_grid(spark, sf_dir):
    return with_500m_cells(derived.trips(spark, sf_dir)).select("trip_id")


@query("null_nan_counts", ctes(TRIPS) + "SELECT " + ", ".join(
    f"count(*) FILTER ({c} IS NULL) AS {c}_nulls, count(*) FILTER (isnan({c})) AS {c}_nans"
    for c in COORDINATES) + " FROM trips")
def null_nan_counts(spark, sf_dir):
    return null_and_nan_counts(derived.trips(spark, sf_dir), COORDINATES)


@query("trip_bounds", ctes(TRIPS) + """
    SELECT count(*) AS trips, min(dropoff_unix) AS earliest_dropoff,
        max(dropoff_unix) AS latest_dropoff FROM trips""")
def trip_bounds(spark, sf_dir):
    return derived.trips(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("trips"),
        F.min("dropoff_unix").alias("earliest_dropoff"),
        F.max("dropoff_unix").alias("latest_dropoff"),
    )


@query("day_trips", ctes(TRIPS) + """
    SELECT trip_id FROM trips WHERE dropoff_unix >= 1704844800 AND dropoff_unix < 1704931200""")
def day_trips(spark, sf_dir):
    """A half-open time range: one day."""
    start = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    at = F.col("dropoff_datetime")
    inside = (at >= start) & (at < start + F.expr("INTERVAL 1 DAY"))
    return derived.trips(spark, sf_dir).filter(inside).select("trip_id")


# -- functions ----------------------------------------------------------------------------


@query("parsed_times", ctes(TRIPS) + """
    SELECT trip_id, CASE WHEN trip_id % 3 = 0 THEN pickup_unix
        WHEN trip_id % 3 = 1 THEN pickup_unix - pickup_unix % 60 END AS parsed_unix,
        trip_id % 3 < 2 AS is_time FROM trips""")
def parsed_times(spark, sf_dir):
    """Times as text in two layouts, and text that is no time."""
    text = (
        F.when(F.col("trip_id") % 3 == 0, F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("trip_id") % 3 == 1, F.date_format("pickup_datetime", "dd-MM-yy HH:mm"))
        .otherwise(F.concat(F.lit("trip "), F.col("trip_id").cast("string")))
    )
    written = derived.trips(spark, sf_dir).select("trip_id", text.alias("written"))
    return written.select(
        "trip_id",
        parse_unix("written").alias("parsed_unix"),
        parse_timestamp("written").isNotNull().alias("is_time"),
    )


@query("time_arithmetic", ctes(TRIPS) + """
    SELECT trip_id, pickup_unix * 1000 AS pickup_ms, dropoff_unix - 1800 AS half_hour_before,
        (dropoff_unix - pickup_unix) * 1000 AS duration_ms FROM trips""")
def time_arithmetic(spark, sf_dir):
    return derived.trips(spark, sf_dir).select(
        "trip_id",
        (F.col("pickup_datetime").cast("long") * 1000).alias("pickup_ms"),
        F.unix_seconds(
            F.timestamp_seconds("dropoff_unix") - F.expr("INTERVAL 30 MINUTES")
        ).alias("half_hour_before"),
        ((F.col("dropoff_datetime").cast("long") - F.col("pickup_datetime").cast("long")) * 1000)
        .alias("duration_ms"),
    )


@query("grid_cells", ctes(TRIPS) + f"""
    SELECT trip_id, {cell_deg_sql('pickup_latitude', 'pickup_longitude')} AS cell_deg,
        {cell_500m_x_sql('pickup_latitude', 'pickup_longitude')} || '.' ||
        {cell_500m_y_sql('pickup_latitude')} AS cell_500m,
        CASE WHEN x BETWEEN 1 AND 600 AND y BETWEEN 1 AND 600 THEN x || '.' || y END AS cell_250m
    FROM (SELECT *, {cell_250m_x_sql('pickup_latitude', 'pickup_longitude')} AS x,
        {cell_250m_y_sql('pickup_latitude')} AS y FROM trips)""")
def grid_cells(spark, sf_dir):
    at = ("pickup_latitude", "pickup_longitude")
    cell = cell_250m(*at)
    return derived.trips(spark, sf_dir).select(
        "trip_id",
        cell_deg(*at).alias("cell_deg"),
        cell_500m(*at).alias("cell_500m"),
        cell_name(cell["x"], cell["y"]).alias("cell_250m"),
    )


@query("cell_parts", ctes(TRIPS) + f"""
    SELECT trip_id, CAST(x AS INT) AS cell_x, CAST(y AS INT) AS cell_y
    FROM (SELECT *, {cell_250m_x_sql('dropoff_latitude', 'dropoff_longitude')} AS x,
        {cell_250m_y_sql('dropoff_latitude')} AS y FROM trips)
    WHERE x BETWEEN 1 AND 600 AND y BETWEEN 1 AND 600""")
def cell_parts(spark, sf_dir):
    cell = cell_250m("dropoff_latitude", "dropoff_longitude")
    placed = derived.trips(spark, sf_dir).select("trip_id", cell.alias("cell"))
    return in_grid(placed, "cell").select(
        "trip_id", F.col("cell.x").alias("cell_x"), F.col("cell.y").alias("cell_y")
    )


@query("trip_speeds", ctes(TRIPS) + """
    SELECT trip_id, trip_distance / nullif(trip_time_in_secs / 3600e0, 0) AS speed FROM trips""")
def trip_speeds(spark, sf_dir):
    return derived.trips(spark, sf_dir).select("trip_id", speed_mph().alias("speed"))


@query("number_functions", ctes(TRIPS) + """
    SELECT trip_id, floor(fare_amount)::BIGINT AS floor_fare, trunc(fare_amount)::INT AS int_fare,
        floor(radians(pickup_latitude) * 1e9)::BIGINT AS lat_nanoradians,
        floor(cos(radians(pickup_latitude)) * 1e9)::BIGINT AS cos_billionths,
        least(fare_amount, trip_distance) AS least_value,
        greatest(fare_amount, trip_distance) AS greatest_value,
        fare_amount BETWEEN 10 AND 20 AS middling FROM trips""")
def number_functions(spark, sf_dir):
    return derived.trips(spark, sf_dir).select(
        "trip_id",
        F.floor("fare_amount").alias("floor_fare"),
        F.col("fare_amount").cast("int").alias("int_fare"),
        F.floor(F.radians("pickup_latitude") * 1e9).alias("lat_nanoradians"),
        F.floor(F.cos(F.radians("pickup_latitude")) * 1e9).alias("cos_billionths"),
        F.least("fare_amount", "trip_distance").alias("least_value"),
        F.greatest("fare_amount", "trip_distance").alias("greatest_value"),
        F.col("fare_amount").between(10, 20).alias("middling"),
    )


@query("exploded_cells", ctes(TRIPS) + f"""
    SELECT cell, count(*) AS ends FROM (
        SELECT unnest([{cell_deg_sql('pickup_latitude', 'pickup_longitude')},
            {cell_deg_sql('dropoff_latitude', 'dropoff_longitude')}]) AS cell FROM trips)
    GROUP BY cell""")
def exploded_cells(spark, sf_dir):
    ends = derived.trips(spark, sf_dir).select(
        F.explode(
            F.array(
                cell_deg("pickup_latitude", "pickup_longitude"),
                cell_deg("dropoff_latitude", "dropoff_longitude"),
            )
        ).alias("cell")
    )
    return ends.groupBy("cell").agg(F.count(F.lit(1)).alias("ends"))


@query("filled_trips", ctes(TRIPS) + """
    SELECT trip_id, coalesce(medallion, 'none') AS medallion,
        coalesce(dropoff_longitude, 0e0) AS dropoff_longitude FROM trips""")
def filled_trips(spark, sf_dir):
    return derived.trips(spark, sf_dir).select("trip_id", "medallion", "dropoff_longitude").fillna(
        {"medallion": "none", "dropoff_longitude": 0.0}
    )


@query("complete_trips", ctes(TRIPS) + """
    SELECT trip_id FROM trips WHERE medallion IS NOT NULL AND dropoff_longitude IS NOT NULL""")
def complete_trips(spark, sf_dir):
    return derived.trips(spark, sf_dir).na.drop(
        subset=["medallion", "dropoff_longitude"]
    ).select("trip_id")


@query("payment_labels", ctes(TRIPS) + """
    SELECT CASE payment_type WHEN 'CRD' THEN 'card' ELSE 'cash' END AS label, count(*) AS trips,
        count(*) FILTER (medallion IS NULL) AS unnamed FROM trips GROUP BY 1""")
def payment_labels(spark, sf_dir):
    """Rows built in memory, joined with the trips."""
    labels = spark.createDataFrame(
        [("CRD", "card"), ("CSH", "cash")], "payment_type string, label string"
    )
    joined = derived.trips(spark, sf_dir).join(F.broadcast(labels), "payment_type")
    return joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_if(F.col("medallion").isNull()).alias("unnamed"),
    )


@query("taxis_and_drivers", ctes(TRIPS) + """
    SELECT medallion AS id FROM trips UNION SELECT hack_license FROM trips""")
def taxis_and_drivers(spark, sf_dir):
    trips = derived.trips(spark, sf_dir)
    return trips.select(F.col("medallion").alias("id")).union(trips.select("hack_license")).distinct()


@query("trip_schema_columns", ctes(TRIPS) + """
    SELECT medallion, strftime(make_timestamp(pickup_unix * 1000000), '%Y-%m-%d %H:%M:%S')
        AS pickup_datetime,
        strftime(make_timestamp(dropoff_unix * 1000000), '%Y-%m-%d %H:%M:%S') AS dropoff_datetime,
        pickup_longitude, pickup_latitude, dropoff_longitude, dropoff_latitude FROM trips""")
def trip_schema_columns(spark, sf_dir):
    trips = derived.trips(spark, sf_dir).withColumns(
        {
            c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            for c in ("pickup_datetime", "dropoff_datetime")
        }
    )
    return trips.select(column_names(TRIP_MIN))


@query("sql_cell_function", ctes(TRIPS) + f"""
    SELECT start_cell, count(*) AS trips FROM (
        SELECT {cell_deg_sql('pickup_latitude', 'pickup_longitude')} AS start_cell FROM trips)
    GROUP BY start_cell""")
def sql_cell_function(spark, sf_dir):
    """The grid lookup called from SQL text."""
    register_cell_function(spark)
    derived.trips(spark, sf_dir).createOrReplaceTempView("trips_for_cells")
    return spark.sql(
        "SELECT get_cell_id(pickup_latitude, pickup_longitude) AS start_cell, count(*) AS trips"
        " FROM trips_for_cells GROUP BY 1"
    )


@query("sql_borough_function", ctes(TRIPS, boroughs_of("trips")) + """
    SELECT dropoff_borough, count(*) AS trips FROM placed GROUP BY dropoff_borough""")
def sql_borough_function(spark, sf_dir):
    """The borough lookup called from SQL text."""
    register_borough_function(spark, derived.borough_edges(spark))
    derived.trips(spark, sf_dir).createOrReplaceTempView("trips_for_boroughs")
    return spark.sql(
        "SELECT to_borough(dropoff_longitude, dropoff_latitude) AS dropoff_borough,"
        " count(*) AS trips FROM trips_for_boroughs GROUP BY 1"
    )
