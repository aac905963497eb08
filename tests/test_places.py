import pytest

from wayfare.operators.places import Boroughs, cell_index
from wayfare.session import scratch_path
from wayfare.sources import derived
from wayfare.sources.polygons import read_geojson

NAN = float("nan")
POINTS = {
    "north": (-73.9999, 40.7151, "Northside"),
    "first part": (-73.995, 40.700, "Twinfield"),
    "second part": (-73.9864, 40.700, "Twinfield"),
    "overlap: lowest ordinal": (-73.9864, 40.7091, "Ringwood"),
    "inside the bend": (-73.9954, 40.7091, "Unknown"),
    "body": (-73.9954, 40.7046, "Ringwood"),
    "hole": (-73.9909, 40.7046, "Unknown"),
    "nowhere": (0.0, 0.0, "Unknown"),
    "no longitude": (None, 40.7046, None),
    "no latitude": (-73.9954, None, None),
    "nan": (NAN, 40.7046, "Unknown"),
    "nan latitude": (-73.9954, NAN, "Unknown"),
}


@pytest.fixture(scope="module")
def points(spark):
    rows = [(n, x, y) for n, (x, y, _) in POINTS.items()]
    return spark.createDataFrame(rows, "name string, lon double, lat double")


def expected(null):
    return {n: (b if b is not None else null) for n, (_, _, b) in POINTS.items()}


@pytest.mark.parametrize("height", [0.0007, 0.01, 5.0])
@pytest.mark.parametrize("broadcast_edges", [0, 10_000])
@pytest.mark.parametrize("width", [0.003, 0.5])
def test_lookup(spark, points, height, broadcast_edges, width):
    boroughs = Boroughs(derived.borough_edges(spark), height, broadcast_edges, width)
    found = boroughs.lookup(points, "lon", "lat", "borough")
    assert {r["name"]: r["borough"] for r in found.collect()} == expected("Unknown")


def test_null_stays_null(spark, points):
    found = Boroughs(derived.borough_edges(spark)).lookup(points, "lon", "lat", "b", False)
    assert {r["name"]: r["b"] for r in found.collect()} == expected(None)


def test_geojson_gives_the_same_edges(spark):
    path = scratch_path(spark, "geo")
    spark.createDataFrame([(derived.borough_geojson(),)], "value string").write.text(path)
    read = {tuple(r) for r in read_geojson(spark, path).collect()}
    assert read == set(derived.borough_edge_rows())


def test_point_on_a_west_edge_is_inside_and_on_an_east_edge_outside(spark):
    box = spark.createDataFrame(
        [(0, "box", 0.0, 0.0, 2.0, 0.0), (0, "box", 2.0, 0.0, 2.0, 2.0),
         (0, "box", 2.0, 2.0, 0.0, 2.0), (0, "box", 0.0, 2.0, 0.0, 0.0)],
        "ordinal int, borough string, x1 double, y1 double, x2 double, y2 double")
    at = spark.createDataFrame([("w", 0.0, 1.0), ("e", 2.0, 1.0), ("m", 1.0, 1.0)],
                               "name string, lon double, lat double")
    found = Boroughs(box).lookup(at, "lon", "lat", "b").collect()
    assert {r["name"]: r["b"] for r in found} == {"w": "box", "e": "Unknown", "m": "box"}


def test_shapes_on_one_parallel_share_no_row(spark):
    n = 300
    corners = [(0.0, 0.0, 0.4, 0.0), (0.4, 0.0, 0.4, 0.005), (0.4, 0.005, 0.0, 0.005),
               (0.0, 0.005, 0.0, 0.0)]
    boxes = spark.createDataFrame(
        [(i, f"box {i}", i + a, b, i + c, d) for i in range(n) for a, b, c, d in corners],
        "ordinal int, borough string, x1 double, y1 double, x2 double, y2 double")
    sizes = cell_index(boxes).selectExpr("max(size(shapes))", "count(*)").first()
    assert tuple(sizes) == (1, n)
    at = spark.createDataFrame([(i, i + 0.2) for i in range(n)], "i int, lon double")
    found = Boroughs(boxes).lookup(at.selectExpr("*", "0.001D AS lat"), "lon", "lat", "b").collect()
    assert all(r["b"] == f"box {r['i']}" for r in found)
