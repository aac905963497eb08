from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare import schemas
from wayfare.session import cut_lineage, scratch_path, shared_dir
from wayfare.sources import catalog, files, messages


def test_missing_path_raises(spark):
    with pytest.raises(AnalysisException):
        files.read_parquet(spark, scratch_path(spark, "nothing"))
    with pytest.raises(AnalysisException):
        catalog.register_table(spark, "nothing_there", scratch_path(spark, "nothing"))


def test_partitions_are_pruned(spark):
    path = scratch_path(spark, "parts")
    df = spark.range(1000).select("id", (F.col("id") % 4).alias("part"))
    files.write_table(df, path, partition_by=["part"])
    one = files.read_parquet(spark, path).filter("part = 2")
    assert one.count() == 250
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_other_folders_keep_their_files(spark):
    path = scratch_path(spark, "days")
    days = spark.range(60).select(F.col("id"), (F.col("id") % 3).cast("int").alias("day"))
    files.write_table(days, path, partition_by=["day"])

    def names(day):
        return {(f.name, f.stat().st_mtime_ns) for f in Path(path, f"day={day}").glob("*.parquet")}

    before = {day: names(day) for day in range(3)}
    files.replace_partitions(spark.createDataFrame([(7, 1), (8, 3)], "id long, day int"), path, ["day"])
    assert {d for d in range(3) if names(d) == before[d]} == {0, 2}
    found = files.read_parquet(spark, path).groupBy("day").count()
    assert dict(rows_of(found)) == {0: 20, 1: 1, 2: 20, 3: 1}


def test_top_partitions_are_found_before_the_scan(spark):
    path = scratch_path(spark, "days")
    sizes = {0: 5, 1: 9, 2: 9, None: 3}
    rows = [(i, day) for day, n in sizes.items() for i in range(n)]
    files.write_table(spark.createDataFrame(rows, "id long, day int"), path, partition_by=["day"])
    table = files.read_parquet(spark, path)
    top = files.in_top_partitions(table, "day")
    assert dict(rows_of(top.groupBy("day").count())) == {1: 9, 2: 9}
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    few = files.in_top_partitions(table, "day", table.filter("day is null"))
    assert few.count() == 3 and files.in_top_partitions(table.filter("false"), "day").count() == 0


def test_append_and_error_modes(spark):
    path = scratch_path(spark, "modes")
    files.write_table(spark.range(3), path, mode="error")
    files.write_table(spark.range(3), path, mode="append")
    assert files.read_table(spark, path).count() == 6
    with pytest.raises(AnalysisException):
        files.write_table(spark.range(3), path, mode="error")


def test_published_sample_layout(spark):
    """Blanks after the header's commas, an empty flag, a distance without a leading zero."""
    path = scratch_path(spark, "sample")
    spark.createDataFrame([(1,)], "x int").coalesce(1).select(F.lit(
        "medallion, hack_license, vendor_id, rate_code, store_and_fwd_flag, pickup_datetime,"
        " dropoff_datetime, passenger_count, trip_time_in_secs, trip_distance, pickup_longitude,"
        " pickup_latitude, dropoff_longitude, dropoff_latitude\n"
        "AB,CD,VTS,1,,2013-08-30 07:57:00,2013-08-30 08:30:00,5,1980,.80,-73.9,40.7,-73.8,40.6"
    )).write.text(path)
    row = files.read_csv_spaced(spark, path, schemas.TRIP_2013_FULL).first()
    assert (row["store_and_fwd_flag"], row["trip_distance"], row["pickup_longitude"]) == (
        None, ".80", -73.9
    )
    typed = files.read_csv_spaced(spark, path, schemas.TRIP_2013_TYPED).first()
    assert (typed["trip_distance"], typed["trip_time_in_secs"]) == (0.8, 1980)


def test_lineage_is_cut_in_the_shared_folder(spark):
    cut = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert rows_of(cut)[-1] == (9, 18)
    assert all(shared_dir(spark) in f for f in cut.inputFiles())


def test_slices_are_contiguous_and_whole(spark):
    sliced = messages.sliced(spark.range(1000), 5, "id").groupBy("slice").agg(
        F.min("id"), F.max("id"), F.count("id")
    )
    rows = rows_of(sliced)
    assert len(rows) == 5 and sum(r[3] for r in rows) == 1000
    assert all(a[2] + 1 == b[1] for a, b in zip(rows, rows[1:]))


def test_round_trip_of_a_message(spark):
    df = spark.createDataFrame([("m1", 3, 1.5)], "medallion string, trip_time_in_secs int, fare_amount double")
    sent = messages.encode(df).withColumn("timestamp", F.current_timestamp())
    back = messages.decode(sent, "medallion string, trip_time_in_secs int, fare_amount double")
    assert rows_of(back, "kafka_key", "medallion", "trip_time_in_secs", "fare_amount") == [
        ("m1", "m1", 3, 1.5)
    ]


def test_schema_names():
    assert len(schemas.column_names(schemas.FLIGHT)) == 27
    assert len(schemas.column_names(schemas.TRIP_DEBS)) == 17
    assert len(schemas.column_names(schemas.TRIP_2013_FULL)) == 14
    assert len(schemas.column_names(schemas.route_change_schema())) == 23
    assert len(schemas.column_names(schemas.profit_change_schema())) == 43
