import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare.operators.medians import exact_median
from wayfare.plans import profit as plans

PLACED = (
    "trip_id bigint, medallion string, pickup_unix bigint, dropoff_unix bigint,"
    " start_cell_x int, start_cell_y int, end_cell_x int, end_cell_y int, fare_plus_tip double"
)


def placed(spark, rows):
    """(taxi, pickup, dropoff, end cell x) rows."""
    return spark.createDataFrame(
        [(i, m, p, d, x, 1, x, 1, float(i)) for i, (m, p, d, x) in enumerate(rows)], PLACED
    )


def empties(spark, rows):
    found = plans.empty_taxis(placed(spark, rows))
    return rows_of(found, "tick", "cell_x", "empty_taxis")


def test_empty_for_half_an_hour(spark):
    assert empties(spark, [("a", 100, 900, 5)]) == [(900, 5, 1), (1800, 5, 1), (2700, 5, 1)]
    assert empties(spark, [("a", 100, 901, 5)]) == [(1800, 5, 1), (2700, 5, 1)]


def test_next_pickup_ends_it(spark):
    # picked up exactly at a tick: no longer empty then
    assert empties(spark, [("a", 100, 900, 5), ("a", 1800, 9000, 6)])[:2] == [
        (900, 5, 1), (9000, 6, 1)
    ]
    # a second trip that starts at once clears the first dropoff
    assert (900, 5, 1) not in empties(spark, [("a", 100, 850, 5), ("a", 860, 2000, 6)])


def test_same_second_pickup_does_not_clear(spark):
    assert (900, 5, 1) in empties(spark, [("a", 100, 900, 5), ("a", 900, 5000, 6)])


def test_unnamed_taxis_do_not_count(spark):
    assert empties(spark, [(None, 100, 900, 5)]) == []


def test_pickup_clears_even_if_the_trip_ends_off_the_grid(spark):
    rows = [("a", 100, 850, 5), ("a", 1000, 3000, None)]
    found = plans.empty_taxis(placed(spark, rows))
    assert rows_of(found, "tick", "cell_x", "empty_taxis") == [(900, 5, 1)]


LAT, LON = 41.4, -74.8  # on the grid


def test_end_cells(spark):
    """A trip from or to elsewhere stays, and so does one of many hours."""
    rows = [(1, 0, 600, LAT, LON), (2, 0, 600, 10.0, LON), (3, 0, 40_000, LAT, LON)]
    df = spark.createDataFrame(rows, "trip_id bigint, pickup_unix bigint, dropoff_unix bigint,"
                                     " dropoff_latitude double, dropoff_longitude double")
    found = {r["trip_id"]: r["end_cell_x"] for r in plans.with_end_cells(df).collect()}
    assert set(found) == {1, 2, 3} and found[2] is None and found[1] == found[3] is not None


def test_a_trip_of_eight_hours_keeps_its_taxi_busy(spark):
    found = plans.empty_taxis(placed(spark, [("M1", -900, 0, 5), ("M1", 600, 29_400, 6)]))
    assert rows_of(found, "tick", "cell_x", "empty_taxis") == [(0, 5, 1), (29_700, 6, 1), (30_600, 6, 1)]


@pytest.mark.parametrize("seed", [3, 4])
def test_against_the_definition(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        pickup = rng.randrange(0, 20000)
        rows.append((rng.choice("ab"), pickup, pickup + rng.randrange(1, 4000), rng.randrange(3)))
    expected = {}
    for tick in range(0, 30000, 900):
        for taxi in "ab":
            mine = [(d, i, p, x) for i, (m, p, d, x) in enumerate(rows) if m == taxi]
            past = [t for t in mine if t[0] <= tick]
            if not past:
                continue
            d, _, _, x = max(past)
            if d >= tick - 1800 and not any(d < p <= tick for _, _, p, _ in mine):
                expected[tick, x] = expected.get((tick, x), 0) + 1
    assert empties(spark, rows) == sorted((t, x, n) for (t, x), n in expected.items())


@pytest.mark.parametrize("limit", [1, 2, 1000])
def test_medians(spark, limit):
    rng = random.Random(5)
    groups = {
        "even": [1.0, 2.0, 2.0, 9.0, 9.5, 11.0], "odd": [3.0, 1.0, 2.0], "one": [4.5],
        "same": [7.0] * 8, "gap": [1.0, None, 5.0, None], "none": [None, None],
        "many": [float(rng.randrange(-50, 50)) for _ in range(301)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame([*rows, (None, 2.5)], "g string, v double")
    expected = {None: 2.5}
    for g, values in groups.items():
        known = [v for v in values if v is not None]
        expected[g] = median(known) if known else None
    assert dict(rows_of(exact_median(df, ["g"], "v", "m", limit))) == expected


def test_cells_without_empty_taxis_come_last(spark):
    # cell 5 has an empty taxi at the tick, cell 7 has the higher fare and none
    rows = [("a", 100, 850, 5), ("b", 100, 800, 7), ("b", 850, 6000, 8)]
    areas = plans.profitable_areas(placed(spark, rows), placed(spark, rows)).filter(F.col("tick") == 900)
    assert rows_of(areas, "rank", "cell_x", "empty_taxis", "profitability") == [
        (1, 5, 1, 0.0), (2, 7, 0, None)
    ]
