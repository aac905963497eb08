"""Files, tables, the catalog, messages and polygons: written to the shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import schemas
from wayfare.operators.places import Boroughs
from wayfare.operators.skew import same
from wayfare.plans.flights import rename_columns, with_calendar
from wayfare.queries.base import FLIGHTS, ROUTES, TRIPS, boroughs_of, ctes, query
from wayfare.session import cut_lineage, scratch_path
from wayfare.sources import catalog, derived, files, messages
from wayfare.sources.polygons import read_geojson

TEXT_TIME = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%d %H:%M:%S')"
SAMPLE_SQL = ctes(TRIPS) + f"""
    SELECT medallion, hack_license, CAST(trip_id AS VARCHAR) AS vendor_id,
        {TEXT_TIME.format('pickup_unix')} AS pickup_datetime,
        {TEXT_TIME.format('dropoff_unix')} AS dropoff_datetime, passenger_count,
        pickup_longitude, dropoff_longitude FROM trips"""
SAMPLE_SHOWN = ["medallion", "hack_license", "vendor_id", "pickup_datetime", "dropoff_datetime",
                "passenger_count", "pickup_longitude", "dropoff_longitude"]


def _sample_rows(spark, sf_dir) -> DataFrame:
    """Trips in the 12-column layout, the vendor column holding the trip's number."""
    trips = derived.trips(spark, sf_dir)
    return trips.select(
        "medallion",
        "hack_license",
        F.col("trip_id").cast("string").alias("vendor_id"),
        F.lit("1").alias("rate_code"),
        F.lit(None).cast("string").alias("store_and_fwd_flag"),
        F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm:ss").alias("pickup_datetime"),
        F.date_format("dropoff_datetime", "yyyy-MM-dd HH:mm:ss").alias("dropoff_datetime"),
        "passenger_count",
        "pickup_longitude",
        "pickup_latitude",
        "dropoff_longitude",
        "dropoff_latitude",
    )


@query("csv_schema_scan", SAMPLE_SQL)
def csv_schema_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(_sample_rows(spark, sf_dir), path)
    return files.read_csv(spark, path, schemas.TRIP_2013_SAMPLE).select(SAMPLE_SHOWN)


@query("csv_headerless_scan", SAMPLE_SQL)
def csv_headerless_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(_sample_rows(spark, sf_dir), path, header=False)
    return files.read_csv(spark, path, schemas.TRIP_2013_SAMPLE, header=False).select(SAMPLE_SHOWN)


@query("csv_inferred_scan", ctes(ROUTES) + """
    SELECT src, dst, count(*) AS flights FROM edges GROUP BY src, dst""")
def csv_inferred_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    edges = derived.flight_routes(spark, sf_dir)
    files.write_csv(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("flights")), path)
    return files.read_csv(spark, path).select(
        "src", "dst", F.col("flights").cast("bigint").alias("flights")
    )


@query("csv_permissive_scan", ctes(TRIPS) + """
    SELECT CAST(trip_id AS VARCHAR) AS medallion,
        CASE WHEN trip_id % 10 <> 0 THEN passenger_count END AS passenger_count,
        trip_id % 10 = 0 AS is_corrupt FROM trips""")
def csv_permissive_scan(spark, sf_dir):
    """Every tenth line has a word where a number belongs."""
    path = scratch_path(spark, "csv")
    count = F.when(F.col("trip_id") % 10 == 0, F.lit("many")).otherwise(
        F.col("passenger_count").cast("string")
    )
    derived.trips(spark, sf_dir).select(F.concat_ws(",", "trip_id", count)).write.text(path)
    read = files.read_csv_permissive(
        spark, path, "medallion string, passenger_count int", header=False
    )
    return read.select(
        "medallion", "passenger_count", F.col("_corrupt_record").isNotNull().alias("is_corrupt")
    )


@query("csv_glob_scan", ctes(TRIPS) + """
    SELECT 'trip_data_' || (trip_id % 3 + 1) AS part, count(*) AS trips,
        CAST(sum(passenger_count) AS BIGINT) AS passengers FROM trips GROUP BY 1""")
def csv_glob_scan(spark, sf_dir):
    """Three file sets, each the trips of one month number, read by one glob."""
    base = scratch_path(spark, "csv")
    rows = _sample_rows(spark, sf_dir)
    for i in range(3):
        part = rows.filter(F.col("vendor_id").cast("bigint") % 3 == i)
        files.write_csv(part, f"{base}/trip_data_{i + 1}")
    read = files.read_csv(spark, f"{base}/trip_data_*", schemas.TRIP_2013_SAMPLE)
    placed = files.with_file_name(read, "part", level=2)
    return placed.groupBy("part").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("passenger_count").alias("passengers")
    )


@query("csv_spaced_header", SAMPLE_SQL)
def csv_spaced_header(spark, sf_dir):
    """A header with blanks after its commas, as in the published files."""
    path = scratch_path(spark, "csv")
    rows = _sample_rows(spark, sf_dir)
    spaced = rows.toDF(rows.columns[0], *[f" {c}" for c in rows.columns[1:]])
    files.write_csv(spaced, path, ignoreLeadingWhiteSpace=False)
    return files.read_csv_spaced(spark, path, schemas.TRIP_2013_SAMPLE).select(SAMPLE_SHOWN)


@query("csv_stripped_names", ctes(TRIPS) + """
    SELECT trip_id, fare_amount FROM trips""")
def csv_stripped_names(spark, sf_dir):
    path = scratch_path(spark, "csv")
    trips = derived.trips(spark, sf_dir).select("trip_id", F.col("fare_amount").alias(" fare_amount"))
    files.write_csv(trips, path, ignoreLeadingWhiteSpace=False)
    read = files.strip_names(files.read_csv(spark, path))
    return read.select(
        F.col("trip_id").cast("bigint").alias("trip_id"),
        F.col("fare_amount").cast("double").alias("fare_amount"),
    )


@query("parquet_pinned_scan", """
    SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events
    GROUP BY event_type""")
def parquet_pinned_scan(spark, sf_dir):
    events = files.read_parquet(
        spark, f"{sf_dir}/events.parquet", "event_type string, user_id bigint"
    )
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")
    )


PLAIN_TRIPS = ctes(TRIPS) + "SELECT trip_id, medallion, pickup_unix, fare_amount FROM trips"


def _plain(spark, sf_dir):
    return derived.trips(spark, sf_dir).select("trip_id", "medallion", "pickup_unix", "fare_amount")


@query("parquet_round_trip", PLAIN_TRIPS)
def parquet_round_trip(spark, sf_dir):
    path = scratch_path(spark, "trips")
    files.write_table(_plain(spark, sf_dir), path, mode="error")
    return files.read_parquet(spark, path)


@query("partitioned_round_trip", ctes(FLIGHTS) + """
    SELECT OP_CARRIER AS UniqueCarrier, CAST(month(FL_DATE) AS INT) AS Month,
        CAST(dayofweek(FL_DATE) + 1 AS INT) AS DayOfWeek, count(*) AS flights FROM flights
    WHERE month(FL_DATE) = 3 GROUP BY 1, 2, 3""")
def partitioned_round_trip(spark, sf_dir):
    """Written in folders by month and weekday; the filter reads one month's folders only."""
    path = scratch_path(spark, "flights")
    dated = with_calendar(rename_columns(derived.flights(spark, sf_dir)))
    files.write_table(dated, path, partition_by=["Month", "DayOfWeek"])
    march = files.read_parquet(spark, path).filter(F.col("Month") == 3)
    return march.groupBy("UniqueCarrier", "Month", "DayOfWeek").agg(
        F.count(F.lit(1)).alias("flights")
    )


def _dated_table(spark, sf_dir) -> str:
    path = scratch_path(spark, "flights")
    dated = with_calendar(rename_columns(derived.flights(spark, sf_dir)))
    files.write_table(dated, path, partition_by=["Month"])
    return path


@query("replaced_partitions", ctes(FLIGHTS) + """
    SELECT CAST(month(FL_DATE) AS INT) AS Month, CAST(dayofweek(FL_DATE) + 1 AS INT) AS DayOfWeek,
        count(*) AS flights FROM flights
    WHERE month(FL_DATE) <> 3 OR dayofweek(FL_DATE) BETWEEN 1 AND 5 GROUP BY 1, 2""")
def replaced_partitions(spark, sf_dir):
    """March is written again without its weekends; the other months' folders stay."""
    path = _dated_table(spark, sf_dir)
    march = files.read_parquet(spark, path).filter((F.col("Month") == 3) & F.col("DayOfWeek").between(2, 6))
    files.replace_partitions(cut_lineage(march), path, ["Month"])
    return files.read_parquet(spark, path).groupBy("Month", "DayOfWeek").agg(F.count(F.lit(1)).alias("flights"))


@query("busiest_month", ctes(FLIGHTS) + """
    , months AS (SELECT CAST(month(FL_DATE) AS INT) AS Month, count(*) AS n FROM flights GROUP BY 1)
    SELECT CAST(month(FL_DATE) AS INT) AS Month, OP_CARRIER AS UniqueCarrier, count(*) AS flights FROM flights
    WHERE month(FL_DATE) IN (SELECT Month FROM months WHERE n = (SELECT max(n) FROM months)) GROUP BY 1, 2""")
def busiest_month(spark, sf_dir):
    """Carriers in the month with the most flights, whose folder alone is read again."""
    table = files.read_parquet(spark, _dated_table(spark, sf_dir))
    return files.in_top_partitions(table, "Month").groupBy("Month", "UniqueCarrier").agg(
        F.count(F.lit(1)).alias("flights"))


@query("table_overwrite", PLAIN_TRIPS)
def table_overwrite(spark, sf_dir):
    """Overwriting replaces the table, it does not add to it."""
    path = scratch_path(spark, "trips")
    files.write_table(_plain(spark, sf_dir), path)
    files.write_table(_plain(spark, sf_dir), path)
    return files.read_table(spark, path)


def _new_name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:10]}"


@query("external_table", PLAIN_TRIPS)
def external_table(spark, sf_dir):
    path, name = scratch_path(spark, "trips"), _new_name("trips")
    files.write_table(_plain(spark, sf_dir), path)
    return catalog.register_table(spark, name, path, replace=True)


@query("result_tables", ctes(TRIPS) + """
    SELECT payment_type, count(*) AS trips, count(DISTINCT medallion) AS taxis
    FROM trips GROUP BY payment_type""")
def result_tables(spark, sf_dir):
    """Two result tables, registered by name and joined in SQL."""
    trips = derived.trips(spark, sf_dir)
    counts, taxis = _new_name("trip_counts"), _new_name("taxi_counts")
    paths = {counts: scratch_path(spark, counts), taxis: scratch_path(spark, taxis)}
    files.write_table(
        trips.groupBy("payment_type").agg(F.count(F.lit(1)).alias("trips")), paths[counts]
    )
    files.write_table(
        trips.groupBy("payment_type").agg(F.count_distinct("medallion").alias("taxis")),
        paths[taxis],
    )
    catalog.register_results(spark, paths)
    return spark.sql(f"SELECT * FROM {counts} JOIN {taxis} USING (payment_type)")


@query("table_statistics", ctes(TRIPS) + "SELECT count(*) AS rows FROM trips")
def table_statistics(spark, sf_dir):
    path, name = scratch_path(spark, "trips"), _new_name("trips")
    files.write_table(_plain(spark, sf_dir), path)
    catalog.register_table(spark, name, path)
    rows = F.regexp_extract("statistics", r"(\d+) rows", 1).cast("bigint")
    return catalog.analyze(spark, name).select(rows.alias("rows"))


@query("catalog_inspection", ctes(TRIPS) + """
    SELECT true AS listed, column_name, data_type, (SELECT count(*) FROM trips) AS table_rows
    FROM (VALUES ('trip_id', 'bigint'), ('medallion', 'string'), ('pickup_unix', 'bigint'),
        ('fare_amount', 'double')) AS c(column_name, data_type)""")
def catalog_inspection(spark, sf_dir):
    """Columns of a registered table, with the rows it holds."""
    path, name = scratch_path(spark, "trips"), _new_name("trips")
    files.write_table(_plain(spark, sf_dir), path)
    rows = catalog.register_table(spark, name, path).agg(F.count(F.lit(1)).alias("n")).scalar()
    found = catalog.tables_like(spark, name).select("table_name").scalar()
    return catalog.describe(spark, name).select(
        found.isNotNull().alias("listed"), "column_name", "data_type", rows.alias("table_rows")
    )


@query("cached_and_checkpointed", ctes(TRIPS) + """
    SELECT medallion, count(*) AS trips FROM trips GROUP BY medallion""")
def cached_and_checkpointed(spark, sf_dir):
    kept = derived.trips(spark, sf_dir).select("trip_id", "medallion").persist()
    cut = cut_lineage(kept)
    kept.unpersist()
    return cut.groupBy("medallion").agg(F.count(F.lit(1)).alias("trips"))


@query("joined_null_safe", ctes(TRIPS) + """
    SELECT t.trip_id, n.trips FROM trips t
    JOIN (SELECT medallion, count(*) AS trips FROM trips GROUP BY medallion) n
    ON t.medallion IS NOT DISTINCT FROM n.medallion""")
def joined_null_safe(spark, sf_dir):
    """Trips with the number of trips of their taxi; unnamed taxis count as one."""
    trips = derived.trips(spark, sf_dir).select("trip_id", "medallion")
    counts = trips.groupBy("medallion").agg(F.count(F.lit(1)).alias("trips"))
    return trips.join(counts, same(trips, counts, ["medallion"])).select("trip_id", "trips")


# -- messages -----------------------------------------------------------------------------

DEBS_COLUMNS = schemas.column_names(schemas.TRIP_DEBS)


def debs_rows(spark, sf_dir) -> DataFrame:
    return derived.trips(spark, sf_dir).select(DEBS_COLUMNS)


@query("envelope_encode", ctes(TRIPS) + """
    SELECT medallion AS key, hack_license, CAST(trip_time_in_secs AS VARCHAR) AS seconds,
        payment_type FROM trips""")
def envelope_encode(spark, sf_dir):
    encoded = messages.encode(debs_rows(spark, sf_dir))
    return encoded.select(
        "key",
        F.get_json_object("value", "$.hack_license").alias("hack_license"),
        F.get_json_object("value", "$.trip_time_in_secs").alias("seconds"),
        F.get_json_object("value", "$.payment_type").alias("payment_type"),
    )


DECODED = ["kafka_key", "medallion", "hack_license", "trip_time_in_secs", "trip_distance",
           "pickup_longitude", "dropoff_longitude", "fare_amount", "total_amount"]
DECODED_SQL = """SELECT medallion AS kafka_key, medallion, hack_license, trip_time_in_secs,
    trip_distance, pickup_longitude, dropoff_longitude, fare_amount, total_amount,
    dropoff_unix AS arrived, pickup_unix FROM trips"""


@query("envelope_decode", ctes(TRIPS) + DECODED_SQL)
def envelope_decode(spark, sf_dir):
    rows = debs_rows(spark, sf_dir)
    sent = messages.encode(rows.withColumn("sent", F.col("dropoff_datetime"))).withColumn(
        "timestamp", F.get_json_object("value", "$.sent").try_cast("timestamp")
    )
    decoded = messages.decode(sent, schemas.TRIP_DEBS)
    return decoded.select(
        *DECODED,
        F.unix_seconds("kafka_timestamp").alias("arrived"),
        F.unix_seconds("pickup_datetime").alias("pickup_unix"),
    )


@query("envelope_mixed", ctes(TRIPS) + """
    SELECT medallion IS NULL AS unnamed, hack_license IS NULL AS unreadable, count(*) AS messages
    FROM (SELECT CASE WHEN trip_id % 4 <> 0 THEN medallion END AS medallion,
        CASE WHEN trip_id % 4 <> 0 THEN hack_license END AS hack_license FROM trips)
    GROUP BY 1, 2""")
def envelope_mixed(spark, sf_dir):
    """Messages that are no JSON become empty rows, which the cleaning rules drop later."""
    trips = derived.trips(spark, sf_dir)
    value = F.when(F.col("trip_id") % 4 == 0, F.lit("no json")).otherwise(
        F.to_json(F.struct(*DEBS_COLUMNS))
    )
    mixed = trips.select(
        F.col("medallion").alias("key"), value.alias("value"),
        F.col("dropoff_datetime").alias("timestamp"),
    )
    decoded = messages.decode(mixed, schemas.TRIP_DEBS)
    return decoded.groupBy(
        F.col("medallion").isNull().alias("unnamed"),
        F.col("hack_license").isNull().alias("unreadable"),
    ).agg(F.count(F.lit(1)).alias("messages"))


@query("sliced_publish", ctes(TRIPS) + """
    SELECT count(*) AS trips, true AS contiguous FROM trips""")
def sliced_publish(spark, sf_dir):
    """Slices of the trips hold all of them and do not overlap."""
    sliced = messages.sliced(derived.trips(spark, sf_dir).select("trip_id"), 4, "trip_id")
    bounds = sliced.groupBy("slice").agg(
        F.min("trip_id").alias("first"), F.max("trip_id").alias("last"),
        F.count(F.lit(1)).alias("trips"),
    )  # a row per slice
    line = F.array_sort(F.collect_list(F.struct("first", "last")))
    flat = F.flatten(F.transform(line, lambda s: F.array(s["first"], s["last"])))
    return bounds.agg(F.sum("trips").alias("trips"),
                      (flat == F.array_sort(flat)).alias("contiguous"))


@query("polygon_scan", ctes(TRIPS, boroughs_of("trips")) + """
    SELECT pickup_borough, count(*) AS trips FROM placed GROUP BY pickup_borough""")
def polygon_scan(spark, sf_dir):
    """Boroughs read from GeoJSON and used on the trips."""
    path = scratch_path(spark, "boroughs")
    spark.createDataFrame([(derived.borough_geojson(),)], "value string").write.text(path)
    boroughs = Boroughs(read_geojson(spark, path))
    placed = boroughs.lookup(
        derived.trips(spark, sf_dir), "pickup_longitude", "pickup_latitude", "pickup_borough"
    )
    return placed.groupBy("pickup_borough").agg(F.count(F.lit(1)).alias("trips"))
