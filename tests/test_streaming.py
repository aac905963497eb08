"""Streams in several files, with late rows and restarts, against their batch twins."""

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare import schemas
from wayfare.operators.cleaning import clean_trips
from wayfare.plans import profit as batch_profit
from wayfare.plans import routes as batch_routes
from wayfare.session import scratch_path
from wayfare.sources import derived, files, messages
from wayfare.streaming import empty, ingest, late, profit, routes
from wayfare.streaming.feeds import run_changes
from wayfare.streaming.run import (
    active_queries,
    append_table,
    complete_table,
    console,
    drain,
    progress,
    publish,
    read_complete,
    read_published,
    read_updates,
    update_table,
)

HALF_HOUR = 1800


@pytest.fixture(scope="module")
def trips(spark, tiny):
    return clean_trips(derived.trips(spark, tiny)).persist()


@pytest.fixture(scope="module")
def arriving(spark, trips):
    """The trips in four files, one after another by dropoff time."""
    path = scratch_path(spark, "arriving")
    bounds = trips.approxQuantile("dropoff_unix", [0.25, 0.5, 0.75], 0.0)
    cuts = [0, *[int(b) for b in bounds], 2**62]
    for lo, hi in zip(cuts, cuts[1:]):
        part = trips.filter((F.col("dropoff_unix") >= lo) & (F.col("dropoff_unix") < hi))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, arriving, trips, max_files=1):
    return ingest.file_stream(spark, arriving, trips.schema, max_files)


def places(spark):
    base = scratch_path(spark, "stream")
    return f"{base}/table", f"{base}/checkpoint"


def latest(trips):
    return trips.agg(F.max("dropoff_unix")).first()[0]


WINDOW_COLUMNS = ["window_start", "window_end", "start_cell", "end_cell", "number_of_rides"]


def test_complete_equals_batch(spark, trips, arriving):
    table, checkpoint = places(spark)
    query = drain(routes.run_route_windows(stream(spark, arriving, trips), table, checkpoint))
    assert len(progress(query)) >= 4
    found = rows_of(read_complete(spark, table), *WINDOW_COLUMNS)
    assert found == rows_of(batch_routes.windowed_routes(trips), *WINDOW_COLUMNS)


def test_append_equals_the_closed_windows(spark, trips, arriving):
    table, checkpoint = places(spark)
    drain(append_table(routes.route_windows(stream(spark, arriving, trips)), table, checkpoint))
    closed = batch_routes.windowed_routes(trips).filter(
        F.col("window_end") <= latest(trips) - HALF_HOUR
    )
    found = files.read_table(spark, table)
    assert rows_of(found, *WINDOW_COLUMNS) == rows_of(closed, *WINDOW_COLUMNS)


def test_late_row_is_dropped_in_append_and_kept_in_complete(spark, trips):
    path = scratch_path(spark, "late")
    late = trips.orderBy("dropoff_unix").limit(1)
    newest = trips.orderBy(F.desc("dropoff_unix"))
    # a batch drops what was late before the batch in front of it: two batches on time
    for part in (newest.offset(25).limit(25), newest.limit(25), late):
        part.coalesce(1).write.mode("append").parquet(path)
    source = stream(spark, path, trips)
    appended, checkpoint = places(spark)
    drain(append_table(routes.route_windows(source), appended, checkpoint))
    complete, checkpoint = places(spark)
    drain(routes.run_route_windows(source, complete, checkpoint))
    first = late.select(F.col("dropoff_unix") - F.col("dropoff_unix") % HALF_HOUR).first()[0]
    starts = [r[0] for r in rows_of(files.read_table(spark, appended), "window_start")]
    assert starts and first not in starts
    assert first in [r[0] for r in rows_of(read_complete(spark, complete), "window_start")]


def test_restart_goes_on_where_it_stopped(spark, trips):
    path, (table, checkpoint) = scratch_path(spark, "restart"), places(spark)
    half = trips.agg(F.percentile_approx("dropoff_unix", 0.5)).first()[0]
    for rule in (F.col("dropoff_unix") <= half, F.col("dropoff_unix") > half):
        trips.filter(rule).coalesce(1).write.mode("append").parquet(path)
        source = ingest.file_stream(spark, path, trips.schema)
        drain(append_table(source.select("trip_id"), table, checkpoint))
    assert rows_of(files.read_table(spark, table)) == rows_of(trips.select("trip_id"))


CELLS = [c for i in range(1, 11) for c in (f"start_cell_id_{i}", f"end_cell_id_{i}")]


def test_route_changes_do_not_depend_on_the_batches(spark, trips, arriving):
    found = []
    for max_files in (1, None):
        table, checkpoint = places(spark)
        drain(routes.run_route_changes(stream(spark, arriving, trips, max_files), table, checkpoint))
        rows = files.read_table(spark, table)
        assert rows.filter(~(F.col("delay") >= 0)).count() == 0
        assert set(schemas.column_names(schemas.route_change_schema())) <= set(rows.columns)
        found.append(rows_of(rows, "window_start", "dropoff_datetime", *CELLS))
    assert found[0] == found[1] and len(found[0]) > 10


def test_change_feed_after_restart_does_not_repeat_itself(spark, trips, arriving):
    table, checkpoint = places(spark)
    for _ in range(2):
        drain(routes.run_route_changes(stream(spark, arriving, trips), table, checkpoint))
    starts = [r[0] for r in rows_of(files.read_table(spark, table), "window_start")]
    assert len(starts) == len(set(starts))


def test_equal_sets_are_no_change(spark):
    """Counts and order may differ: routes are compared as a set, cells as a list."""
    from wayfare.streaming.feeds import changes

    rows = []
    for window, counts in enumerate([(3, 2), (2, 3), (5, 0)]):
        for name, n in zip("ab", counts):
            if n:
                rows.append((window, window + 1, name, n))
    df = spark.createDataFrame(rows, "window_start bigint, window_end bigint, c string, n int")
    now = F.current_timestamp()
    df = df.withColumns({"trigger_pickup": now, "trigger_dropoff": now, "ingested": now})
    order = [F.desc("n"), F.asc("c")]

    def starts(ordered, last=None):
        found = changes(df, order, 10, F.col("c"), ordered, {"c": "cell"}, last)
        return [r[0] for r in rows_of(found, "window_start")]

    assert starts(False) == [0, 2]
    assert starts(True) == [0, 1, 2]
    known = spark.createDataFrame([(-1, "a,b")], "window_start bigint, entries string")
    assert starts(False, known) == [2]
    assert starts(True, known) == [1, 2]


def test_profit_and_taxis_equal_batch(spark, trips, arriving):
    table, checkpoint = places(spark)
    drain(append_table(profit.profitability_windows(stream(spark, arriving, trips)), table, checkpoint))
    columns = ["window_start", "cell_x", "cell_y", "median_fare_tip", "empty_taxis"]
    placed = batch_profit.with_250m_cells(trips)
    taxis = batch_profit.taxis_by_cell(placed).withColumnRenamed(
        "window_start", "empty_start"
    )
    joined = batch_profit.profit_by_cell(placed).withColumn(
        "empty_start", F.col("window_start") - F.col("window_start") % HALF_HOUR
    ).join(taxis, ["empty_start", "cell_x", "cell_y"])
    closed = joined.filter(F.col("empty_start") + HALF_HOUR <= latest(trips) - 35 * 60)
    assert rows_of(files.read_table(spark, table), *columns) == rows_of(closed, *columns)


def test_profit_changes(spark, trips, arriving):
    table, checkpoint = places(spark)
    drain(profit.run_profit_changes(stream(spark, arriving, trips), table, checkpoint))
    rows = files.read_table(spark, table)
    assert set(schemas.column_names(schemas.profit_change_schema())) <= set(rows.columns)
    assert rows.count() > 10


def told(spark, rows, trips, lateness="35 minutes"):
    """Empty taxis after `rows`, lists of trips, have arrived one list after another."""
    source, (table, checkpoint) = scratch_path(spark, "told"), places(spark)
    for part in rows:
        part.select(*trips.columns).coalesce(1).write.mode("append").parquet(source)
        claims = empty.taxi_claims(ingest.file_stream(spark, source, trips.schema), lateness=lateness)
        drain(append_table(claims, table, checkpoint))
    return empty.empty_taxis_told(files.read_table(spark, table))


EMPTY_COLUMNS = ["tick", "cell_x", "cell_y", "empty_taxis"]


def test_empty_taxis_equal_batch(spark, trips, arriving):
    """Trips of any length arrive, and both take all of them."""
    assert trips.filter("dropoff_unix - pickup_unix > 14400").count() > 0
    table, checkpoint = places(spark)
    drain(append_table(empty.taxi_claims(stream(spark, arriving, trips)), table, checkpoint))
    found = empty.empty_taxis_told(files.read_table(spark, table))
    expected = batch_profit.empty_taxis(batch_profit.with_end_cells(trips))
    assert rows_of(found, *EMPTY_COLUMNS) == rows_of(
        expected.filter(F.col("tick") < latest(trips) - 35 * 60), *EMPTY_COLUMNS)


def test_a_pickup_known_eight_hours_later_corrects_closed_ticks(spark, trips):
    """M1 drops off at 0 and picks up at 600 for eight hours; others let time pass meanwhile."""
    some = trips.limit(1).drop("medallion", "trip_id", "pickup_unix", "dropoff_unix", "pickup_datetime",
                               "dropoff_datetime", "dropoff_latitude", "dropoff_longitude")

    day = 86_400 * 365  # a stream's time begins at zero

    def trip(number, taxi, pickup, dropoff):
        pickup, dropoff = day + pickup, day + dropoff
        return some.select(
            "*", F.lit(number).cast("long").alias("trip_id"), F.lit(taxi).alias("medallion"),
            F.lit(pickup).cast("long").alias("pickup_unix"), F.lit(dropoff).cast("long").alias("dropoff_unix"),
            F.timestamp_seconds(F.lit(pickup)).alias("pickup_datetime"),
            F.timestamp_seconds(F.lit(dropoff)).alias("dropoff_datetime"),
            F.lit(41.4).alias("dropoff_latitude"), F.lit(-74.8).alias("dropoff_longitude"))

    first, long = trip(1, "M1", -900, 0), trip(4, "M1", 600, 600 + 8 * 3600)
    early = [first, trip(2, "M2", 5000, 7000), trip(3, "M2", 7100, 29_000)]
    ticks = [r["tick"] - day for r in told(spark, early, trips).collect() if r["tick"] - day < 2000]
    assert sorted(ticks) == [0, 900, 1800]
    end = trip(5, "M3", 39_000, 40_000)
    every = [*early, long, end]
    found = rows_of(told(spark, every, trips), *EMPTY_COLUMNS)
    whole = every[0]
    for part in every[1:]:
        whole = whole.unionByName(part)
    batch = batch_profit.empty_taxis(batch_profit.with_end_cells(whole))
    assert found == rows_of(batch.filter(F.col("tick") < day + 40_000 - 2100), *EMPTY_COLUMNS)
    assert [t - day for t, *_ in found] == [0, 29_700, 30_600]


def test_late_rows_are_kept_apart_and_merged(spark, trips):
    """Trips in no order at all: some come when their window has closed, none is lost."""
    base, source = scratch_path(spark, "routed"), scratch_path(spark, "unordered")
    timely, gone, table = f"{base}/timely", f"{base}/late", f"{base}/closed"
    for i in range(3):
        part = trips.filter(F.pmod(F.xxhash64("trip_id"), F.lit(3)) == i)
        part.write.mode("append").parquet(source)
        drain(late.run_routed(ingest.file_stream(spark, source, trips.schema), timely, gone, f"{base}/checkpoint"))
        routed = ingest.file_stream(spark, timely, trips.schema).select(*trips.columns)
        drain(append_table(routes.route_windows(routed), table, f"{base}/windows"))
    apart = spark.read.parquet(gone)
    assert apart.count() > 100
    assert spark.read.parquet(timely).count() + apart.count() == trips.count()
    columns = ["window_start", "window_end", "start_cell", "end_cell", "number_of_rides"]
    batch = batch_routes.windowed_routes(trips)
    closed = files.read_table(spark, table)
    merged = late.corrected(closed, batch_routes.windowed_routes(apart), columns[:4], columns[4:])
    assert closed.count() < merged.count()
    assert rows_of(merged, *columns) == rows_of(
        batch.filter(F.col("window_end") <= latest(trips) - HALF_HOUR), *columns)


def test_a_repeated_batch_routes_the_same_rows(spark, trips):
    """The newest event counts without the batch itself, so a repeat finds what the first try found."""
    base, source = scratch_path(spark, "routed"), scratch_path(spark, "again")
    for part in (trips.orderBy(F.desc("dropoff_unix")).limit(20), trips.orderBy("dropoff_unix").limit(20)):
        part.coalesce(1).write.mode("append").parquet(source)
    stream_of = ingest.file_stream(spark, source, trips.schema, max_files=1)
    drain(late.run_routed(stream_of, f"{base}/timely", f"{base}/late", f"{base}/checkpoint"))
    assert spark.read.parquet(f"{base}/late/batch_id=1").count() == 20
    assert read_published(spark, f"{base}/checkpoint/newest", 1).first()[0] == latest(trips)


def test_reader_is_not_disturbed_by_newer_versions(spark):
    path = scratch_path(spark, "versions")
    assert read_published(spark, path) is None
    with pytest.raises(ValueError):
        read_complete(spark, path)
    publish(spark.range(3), path, 0)
    reader = read_complete(spark, path)
    for version in (1, 2):
        publish(spark.range(10 * version), path, version)
        assert read_complete(spark, path).count() == 10 * version
    assert reader.count() == 3
    publish(spark.range(7), path, 2)  # a repeated batch replaces its version
    assert read_complete(spark, path).count() == 7
    assert read_published(spark, path, before=2).count() == 10


def test_feed_writes_only_changes_and_one_row_of_state(spark):
    rows = [(w, w + 10, c, n) for w in range(0, 60, 10) for c, n in (("a", 2), ("b", 1))]
    schema = "window_start bigint, window_end bigint, c string, n int"
    source, (table, checkpoint) = scratch_path(spark, "windows"), places(spark)
    now = F.current_timestamp()
    for row in range(0, len(rows), 2):
        spark.createDataFrame(rows[row:row + 2], schema).coalesce(1).write.mode("append").parquet(source)
        arrived = ingest.file_stream(spark, source, schema).withColumns(
            {"trigger_pickup": now, "trigger_dropoff": now, "ingested": now})
        drain(run_changes(arrived, [F.desc("n"), F.asc("c")], 2, F.col("c"), True, {"c": "cell"},
                          table, checkpoint))
    found = files.read_table(spark, table)
    assert rows_of(found, "window_start", "batch_id") == [(0, 0)]
    assert read_published(spark, f"{checkpoint}/said").count() == 1


def test_update_mode_equals_complete(spark, trips, arriving):
    table, checkpoint = places(spark)
    windows = routes.route_windows(stream(spark, arriving, trips))
    drain(update_table(windows, table, checkpoint))
    found = read_updates(spark, table, WINDOW_COLUMNS[:-1])
    assert rows_of(found, *WINDOW_COLUMNS) == rows_of(
        batch_routes.windowed_routes(trips), *WINDOW_COLUMNS)


def test_garbage_goes_to_raw_but_not_to_clean(spark, trips):
    topic, (raw, checkpoint) = scratch_path(spark, "topic"), places(spark)
    rows = trips.select(schemas.column_names(schemas.TRIP_DEBS))
    messages.publish_files(rows, topic, F.col("dropoff_datetime"))
    garbage = spark.createDataFrame([("k", "not json"), ("k", "{}"), (None, None)],
                                    "key string, value string")
    garbage.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(topic)
    drain(ingest.run_raw(ingest.message_files(spark, topic), schemas.TRIP_DEBS, raw, checkpoint))
    assert files.read_table(spark, raw).count() == rows.count() + 3
    clean, checkpoint = places(spark)
    schema = f"kafka_key string, kafka_timestamp timestamp, {schemas.TRIP_DEBS}"
    drain(ingest.run_clean(ingest.file_stream(spark, raw, schema), clean, checkpoint))
    assert files.read_table(spark, clean).count() == rows.count()


def test_running_query_is_listed_and_stops(spark, trips, arriving):
    table, checkpoint = places(spark)
    source = stream(spark, arriving, trips).select("trip_id")
    query = append_table(source, table, checkpoint, every="1 second", name="listed")
    try:
        assert "listed" in [q["name"] for q in active_queries(spark)]
        query.processAllAvailable()
    finally:
        query.stop()
    assert files.read_table(spark, table).count() == trips.count()
    assert active_queries(spark) == []


def test_console_and_complete_sink(spark, trips, arriving):
    drain(console(stream(spark, arriving, trips, None).groupBy().count(), "complete"))
    table, checkpoint = places(spark)
    counted = stream(spark, arriving, trips).groupBy().count()
    drain(complete_table(counted, table, checkpoint))
    assert rows_of(read_complete(spark, table)) == [(trips.count(),)]


def test_dispatcher(spark, trips, arriving):
    assert routes.frequent_routes(spark, trips).count() <= 10
    assert "tick" in routes.frequent_routes(spark, trips, "rolling").columns
    windows = batch_routes.windowed_routes(trips)
    assert routes.frequent_routes(spark, windows, "windows").count() <= 10
    table, checkpoint = places(spark)
    drain(routes.frequent_routes(spark, stream(spark, arriving, trips), "stream", table, checkpoint))
    assert files.read_table(spark, table).count() > 0
    with pytest.raises(ValueError):
        routes.frequent_routes(spark, trips, "guess")
