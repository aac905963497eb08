import math

import pytest
from pyspark.sql import functions as F

from wayfare.functions import cells, times
from wayfare.functions.measures import profitability, share, speed_mph

LAT0, LON0 = cells.ORIGIN_LATITUDE, cells.ORIGIN_LONGITUDE


def at_500m(x, y):
    """A point in the middle of a 500 m cell, which may lie outside the grid."""
    lat = LAT0 - (y - 0.5) * 500 / 111000
    lon = LON0 + (x - 0.5) * 500 / (111000 * math.cos(math.radians(lat)))
    return lat, lon


def at_250m(x, y):
    radius = cells.EARTH_RADIUS_METRES
    lat_r = math.radians(LAT0) - (y - 0.5) * 250 / radius
    across = radius * math.cos((lat_r + math.radians(LAT0)) / 2)
    return math.degrees(lat_r), math.degrees(math.radians(LON0) + (x - 0.5) * 250 / across)


def evaluate(spark, points, make):
    df = spark.createDataFrame(points, "lat double, lon double")
    return [r[0] for r in df.select(make("lat", "lon")).collect()]


@pytest.mark.parametrize("x,y,known", [
    (1, 1, True), (300, 300, True), (301, 5, False), (5, 301, False), (150, 170, True),
    # truncation folds the half cells just outside the origin into cell 1
    (0, 5, "1.5"), (5, 0, "5.1"), (-1, 5, False), (5, -1, False),
])
def test_cell_500m(spark, x, y, known):
    expected = known if isinstance(known, str) else (f"{x}.{y}" if known else None)
    assert evaluate(spark, [at_500m(x, y)], cells.cell_500m) == [expected]


@pytest.mark.parametrize("x,y,known", [
    (1, 1, True), (600, 600, True), (601, 5, False), (5, 601, False), (0, 5, False),
    (5, 0, False), (308, 341, True),
])
def test_cell_250m(spark, x, y, known):
    found = evaluate(spark, [at_250m(x, y)], cells.cell_250m)[0]
    assert (tuple(found) if found else None) == ((x, y) if known else None)


def test_cell_deg(spark):
    points = [(LAT0 - 2.5 * 0.0045, LON0 + 7.5 * 0.0045), (LAT0 + 0.5 * 0.0045, LON0 - 0.5 * 0.0045),
              (LAT0 + 1.5 * 0.0045, LON0 - 2.5 * 0.0045)]
    assert evaluate(spark, points, cells.cell_deg) == ["8.3", "1.1", "-1.0"]


def test_cells_without_place(spark):
    nan = float("nan")
    points = [(None, -74.0), (40.0, None), (nan, -74.0), (40.0, nan)]
    for make in (cells.cell_deg, cells.cell_500m, cells.cell_250m):
        assert evaluate(spark, points, make) == [None] * 4


def test_parse(spark):
    rows = [("2013-08-30 07:57:00",), ("30-08-13 07:57",), ("yesterday",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(times.parse_unix("t")).collect()] == [
        1377849420, 1377849420, None, None
    ]


def test_window_start(spark):
    df = spark.createDataFrame([(1800,), (3599,), (0,), (-1,)], "t bigint")
    assert [r[0] for r in df.select(times.window_start("t", 1800)).collect()] == [
        1800, 1800, 0, -1800
    ]


def test_ratios(spark):
    df = spark.createDataFrame([(10.0, 360, 0, 0), (10.0, 0, 3, 4)],
                               "trip_distance double, trip_time_in_secs int, a int, b int")
    rows = df.select(
        speed_mph(), share("a", "b"), profitability("trip_distance", "a"), F.lit(1)
    ).collect()
    assert [tuple(r) for r in rows] == [(100.0, None, None, 1), (None, 3 / 7, 10 / 3, 1)]
