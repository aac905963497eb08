import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare.operators.intervals import counts_at_ticks, minute_ticks, ticks_between
from wayfare.operators.ranking import pad_ranks, ranked, slice_rows, widen_ranks
from wayfare.plans import routes as plans

WINDOWS = (
    "window_start bigint, window_end bigint, start_cell string, end_cell string,"
    " number_of_rides bigint"
)


def windows(spark, counts, start=0):
    rows = [(start, start + 1800, f"s{i:02d}", f"e{i:02d}", n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, WINDOWS)


@pytest.mark.parametrize("n", [1, 9, 10, 14])
def test_padding(spark, n):
    found = plans.ranked_top_windows(windows(spark, range(100, 100 - n, -1)), ties=False)
    rows = rows_of(found, "rank", "start_cell")
    assert [r[0] for r in rows] == list(range(1, 11))
    assert sum(r[1] is not None for r in rows) == min(n, 10)


def test_no_window(spark):
    assert plans.ranked_top_windows(spark.createDataFrame([], WINDOWS)).count() == 0


def test_tie_at_the_tenth_place(spark):
    df = windows(spark, [9] * 9 + [5, 5, 5])
    kept = ranked(df, ["window_start"], [F.desc("number_of_rides")], 10, ties=True)
    assert kept.count() == 12
    unique = ranked(df, ["window_start"], plans.route_order("number_of_rides"), 10)
    assert [r[0] for r in rows_of(unique, "start_cell")] == [f"s{i:02d}" for i in range(10)]


def test_all_windows_with_the_greatest_total(spark):
    df = windows(spark, [3, 2]).union(windows(spark, [5], 1800)).union(windows(spark, [4], 3600))
    assert rows_of(plans.top_windows(df), "window_start") == [(0,), (1800,)]


@pytest.mark.parametrize("times", [[0], [0, 60, 1800, 1860, 1861, 3600], [7, 59, 61, 5000]])
def test_rolling_counts_equal_the_range_join(spark, times):
    df = spark.createDataFrame([(t, t % 2) for t in times], "at bigint, g int")
    last = min(times) + -(-(max(times) - min(times)) // 60) * 60
    ticks = range(min(times), last + 1, 60)
    assert [r[0] for r in rows_of(minute_ticks(df, "at"))] == list(ticks)
    expected = {}
    for tick in ticks:
        for t in times:
            if tick - 1800 <= t <= tick:
                expected[tick, t % 2] = expected.get((tick, t % 2), 0) + 1
    found = counts_at_ticks(df, "at", ["g"], 1800)
    assert {(r["tick"], r["g"]): r["num_rides"] for r in found.collect()} == expected


def test_ticks_between(spark):
    df = spark.createDataFrame([(1, 899), (900, 900), (1, 2700), (5, 3)], "a bigint, b bigint")
    found = df.select(ticks_between(F.col("a"), F.col("b"), 900)).collect()
    assert [r[0] for r in found] == [[], [900], [900, 1800, 2700], []]


def test_wide_and_padded(spark):
    rows = spark.createDataFrame([("g", 1, "x"), ("g", 3, "z")], "g string, rank int, v string")
    wide = widen_ranks(rows, ["g"], {"v": "v"}, 3)
    assert rows_of(wide, "g", "v_1", "v_2", "v_3") == [("g", "x", None, "z")]
    padded = pad_ranks(rows.select("g").distinct(), rows, ["g"], 3)
    assert rows_of(padded, "rank", "v") == [(1, "x"), (2, None), (3, "z")]


def test_slice(spark):
    assert rows_of(slice_rows(spark.range(20), 5, 3, F.asc("id"))) == [(5,), (6,), (7,)]


def test_loops_are_left_out(spark):
    at = (40.7, -74.0, 40.7, -74.0)
    df = spark.createDataFrame(
        [(100, 60, 1.0, *at), (200, 60, 1.0, 40.7, -74.0, 40.71, -74.0)],
        "dropoff_unix bigint, trip_time_in_secs int, trip_distance double,"
        " pickup_latitude double, pickup_longitude double,"
        " dropoff_latitude double, dropoff_longitude double",
    )
    assert rows_of(plans.peak_window_routes(df), "num_rides") == [(1,)]
