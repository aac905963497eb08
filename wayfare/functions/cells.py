"""The three grids that map a coordinate to a cell, as plain arithmetic.

The constants are fixed values: cell names must match those users already store.
Integer conversion truncates toward zero in the first two grids and rounds down in the
third. A NULL or NaN coordinate has no cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Centre of the first cell, cell sizes and grid limits.
ORIGIN_LATITUDE = 41.474937
ORIGIN_LONGITUDE = -74.913585
DEGREES_PER_CELL = 0.0045
METRES_PER_DEGREE = 111000
EARTH_RADIUS_METRES = 6371000.0
GRID_500M_CELLS = 300
GRID_250M_CELLS = 600


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def cell_name(x, y) -> Column:
    """`"x.y"`, or NULL when either part is NULL."""
    return F.concat(_col(x).cast("string"), F.lit("."), _col(y).cast("string"))


def cell_deg(latitude, longitude) -> Column:
    """Name of the 0.0045 degree cell; unlimited in every direction."""
    x = ((_col(longitude) - F.lit(ORIGIN_LONGITUDE)) / F.lit(DEGREES_PER_CELL)).try_cast("bigint")
    y = ((F.lit(ORIGIN_LATITUDE) - _col(latitude)) / F.lit(DEGREES_PER_CELL)).try_cast("bigint")
    return cell_name(x + 1, y + 1)


def cells_east_500m(latitude, longitude) -> Column:
    """Cells of 500 m east of the origin, as a fraction."""
    metres = (
        (_col(longitude) - F.lit(ORIGIN_LONGITUDE))
        * F.lit(METRES_PER_DEGREE)
        * F.cos(F.radians(_col(latitude)))
    )
    return metres / F.lit(500)


def cells_south_500m(latitude) -> Column:
    """Cells of 500 m south of the origin, as a fraction."""
    return (F.lit(ORIGIN_LATITUDE) - _col(latitude)) * F.lit(METRES_PER_DEGREE) / F.lit(500)


def in_500m_grid(cells) -> Column:
    """Whether 1 + the whole part lies in 1..300. False for NaN, NULL for NULL."""
    return (_col(cells) > -1) & (_col(cells) < GRID_500M_CELLS)


def cell_500m_number(cells) -> Column:
    return _col(cells).cast("int") + 1


def cell_500m(latitude, longitude) -> Column:
    """Name of the 500 m cell, NULL outside the 300 x 300 grid."""
    east, south = cells_east_500m(latitude, longitude), cells_south_500m(latitude)
    return F.when(
        in_500m_grid(east) & in_500m_grid(south),
        cell_name(cell_500m_number(east), cell_500m_number(south)),
    )


def cells_east_250m(latitude, longitude) -> Column:
    """Cells of 250 m east of the origin, as a fraction."""
    lat, lon = F.radians(_col(latitude)), F.radians(_col(longitude))
    lat0, lon0 = F.lit(math.radians(ORIGIN_LATITUDE)), F.lit(math.radians(ORIGIN_LONGITUDE))
    metres = F.lit(EARTH_RADIUS_METRES) * (lon - lon0) * F.cos((lat + lat0) / F.lit(2.0))
    return metres / F.lit(250.0)


def cells_south_250m(latitude) -> Column:
    """Cells of 250 m south of the origin, as a fraction."""
    metres = F.lit(EARTH_RADIUS_METRES) * (
        F.radians(_col(latitude)) - F.lit(math.radians(ORIGIN_LATITUDE))
    )
    return -metres / F.lit(250.0)


def in_250m_grid(cells) -> Column:
    """Whether a fraction of cells lies in 0 <= c < 600. False for NaN, NULL for NULL."""
    return (_col(cells) >= 0) & (_col(cells) < GRID_250M_CELLS)


def cell_250m_number(cells) -> Column:
    return (F.floor(_col(cells)) + 1).cast("int")


def cell_250m(latitude, longitude) -> Column:
    """`struct<x:int,y:int>` of the 250 m cell, NULL outside the 600 x 600 grid."""
    east, south = cells_east_250m(latitude, longitude), cells_south_250m(latitude)
    return F.when(
        in_250m_grid(east) & in_250m_grid(south),
        F.struct(cell_250m_number(east).alias("x"), cell_250m_number(south).alias("y")),
    )
