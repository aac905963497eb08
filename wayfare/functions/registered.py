"""The grid and borough lookups under names that SQL text can call.

They are SQL functions over built-in expressions: nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.functions import cells
from wayfare.operators.places import CELL_DEGREES, SLAB_DEGREES, cell_index
from wayfare.session import cut_lineage

_ONE_CELL = f"""
    CREATE OR REPLACE TEMPORARY FUNCTION get_cell_id(lat DOUBLE, lon DOUBLE) RETURNS STRING
    RETURN concat(
        CAST(try_cast((lon - {cells.ORIGIN_LONGITUDE}D) / {cells.DEGREES_PER_CELL}D AS BIGINT) + 1
            AS STRING), '.',
        CAST(try_cast(({cells.ORIGIN_LATITUDE}D - lat) / {cells.DEGREES_PER_CELL}D AS BIGINT) + 1
            AS STRING))
"""

# the shapes come in as an argument: a lambda must not hold a subquery
_BOROUGH_AMONG = """
    CREATE OR REPLACE TEMPORARY FUNCTION borough_among(lon DOUBLE, lat DOUBLE, shapes ARRAY<STRUCT<
        ordinal: INT, borough: STRING, west: DOUBLE, east: DOUBLE,
        edges: ARRAY<STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>>>) RETURNS STRING
    RETURN coalesce(
        get(filter(shapes, s -> lon BETWEEN s.west AND s.east AND aggregate(s.edges, 0, (n, e) -> n + if(
            (e.y1 > lat) != (e.y2 > lat)
            AND lon < try_divide(e.x2 - e.x1, e.y2 - e.y1) * (lat - e.y1) + e.x1,
            1, 0)) % 2 = 1), 0).borough,
        'Unknown')
"""

_BOROUGH = """
    CREATE OR REPLACE TEMPORARY FUNCTION to_borough(lon DOUBLE, lat DOUBLE) RETURNS STRING
    RETURN borough_among(lon, lat,
        (SELECT any_value(shapes) FROM {view}
         WHERE slab = floor(lat / {height}D) AND cell = floor(lon / {width}D)))
"""


def register_cell_function(spark: SparkSession) -> None:
    """`get_cell_id(lat, lon)`: the 0.0045 degree cell."""
    spark.sql(_ONE_CELL)


def register_borough_function(spark: SparkSession, edges: DataFrame,
                              view: str = "borough_cells",
                              height: float = SLAB_DEGREES,
                              width: float = CELL_DEGREES) -> None:
    """`to_borough(lon, lat)`: the first polygon that holds the point, else 'Unknown'.

    Spark turns the lookup of the point's cell into a join with the written index, whose size it
    then knows: a small one is broadcast, a large one shuffled and hot cells divided at run time.
    """
    cut_lineage(cell_index(edges, height, width)).createOrReplaceTempView(view)
    spark.sql(_BOROUGH_AMONG)
    spark.sql(_BOROUGH.format(view=view, height=height, width=width))
