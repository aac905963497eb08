import pytest
from pyspark.sql import functions as F

from helpers import rows_of, trips
from wayfare.operators.cleaning import clean_trips, clean_trips_strict, valid_duration
from wayfare.plans import trips as plans


def test_duration_limits(spark):
    rows = [(i, "a", 0, d) for i, d in enumerate([-1, 0, 1, 14400, 14401, None])]
    assert rows_of(valid_duration(trips(spark, rows)), "duration") == [(1,), (14400,)]


@pytest.mark.parametrize("limit", [1, 1000])
def test_idle_time(spark, limit):
    rows = [
        (1, "a", 0, 100),            # first trip: 0
        (2, "a", 14500, 14600),      # gap of exactly four hours counts
        (3, "a", 29001, 29100),      # one second more is off duty
        (4, "a", 29050, 29200),      # overlap: negative
        (5, "b", 0, 10),             # only trip
        (6, None, 0, 10), (7, None, 20, 30),
    ]
    found = plans.with_idle_time(trips(spark, rows), limit)
    assert rows_of(found, "trip_id", "idle_time") == [
        (1, 0), (2, 14400), (3, 0), (4, -50), (5, 0), (6, 0), (7, 10)
    ]


def test_utilization_is_a_share(spark, tiny):
    from wayfare.sources import derived

    table = plans.taxi_utilization(derived.trips(spark, tiny))
    without_overlap = table.filter(F.col("total_idle_time") >= 0)
    assert without_overlap.filter(~F.col("utilization_rate").between(0, 1)).count() == 0


def test_rounding(spark):
    rows = [(1, "a", 0, 3), (2, "a", 7, 10)]
    assert rows_of(plans.driver_utilization(trips(spark, rows)), "utilization_rate") == [(0.6,)]


def test_text_times(spark):
    df = spark.createDataFrame(
        [("2013-01-01 00:00:00", "01-01-13 00:10"), ("x", None)],
        "pickup_datetime string, dropoff_datetime string",
    )
    assert rows_of(plans.with_unix_times(df), "pickup_unix", "dropoff_unix") == [
        (None, None), (1356998400, 1356999000)
    ]


def test_flows_add_up(spark, tiny):
    from wayfare.operators.places import Boroughs
    from wayfare.sources import derived

    placed = Boroughs(derived.borough_edges(spark)).both_ends(derived.trips(spark, tiny)).persist()
    same = plans.same_borough_all(placed).agg(F.sum("same_borough_trip_count")).first()[0]
    other = plans.inter_borough_total(placed).first()[0]
    assert same + other == placed.count()


CLEAN = (
    "medallion string, trip_distance double, trip_time_in_secs int, passenger_count int,"
    " pickup_longitude double, pickup_latitude double,"
    " dropoff_longitude double, dropoff_latitude double"
)
GOOD = ("m", 1.0, 360, 1, -74.0, 40.7, -73.9, 40.8)


@pytest.mark.parametrize("place,value,loose,strict", [
    (None, None, True, True), (0, None, False, False), (1, 0.0, False, False),
    (2, 0, False, False), (3, 0, True, False), (4, 181.0, False, False),
    (5, -91.0, False, False), (6, None, False, False), (7, 0.0, True, False),
    (1, 9.99, True, True), (1, 10.0, False, "flag"), (4, float("nan"), False, False),
])
def test_cleaning(spark, place, value, loose, strict):
    row = list(GOOD)
    if place is not None:
        row[place] = value
    df = spark.createDataFrame([tuple(row)], CLEAN)
    assert clean_trips(df).count() == int(loose)
    kept = clean_trips_strict(df).collect()
    assert len(kept) == int(bool(strict))
    if kept:
        assert kept[0]["is_valid_trip"] == (strict is True)
