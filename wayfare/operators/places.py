"""Point to polygon lookup.

Polygons are cut into horizontal slabs, and slabs into wide cells: a cell lists the polygons that
reach into it, each with its edges in the slab. A point needs no more than its own cell, so the
lookup is an equi-join on the cell and each trip stays one row. Shapes far apart on one
parallel share no cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.shapes import contains
from wayfare.operators.skew import salted_join
from wayfare.session import cut_lineage

SLAB_DEGREES = 0.01
# Cells are wide, since a shape's edges in a slab are repeated in every cell between its ends.
CELL_DEGREES = 0.5
# About 40 bytes an edge: an index of this many edge entries is a broadcast of some 20 MB.
BROADCAST_EDGES = 500_000


def slab_number(latitude: Column, height: float = SLAB_DEGREES) -> Column:
    return F.floor(latitude / F.lit(height))


def cell_number(longitude: Column, width: float = CELL_DEGREES) -> Column:
    return F.floor(longitude / F.lit(width))


def cell_index(edges: DataFrame, height: float = SLAB_DEGREES,
               width: float = CELL_DEGREES) -> DataFrame:
    """`(slab, cell, shapes array<struct<ordinal, borough, west, east, edges>>)` from polygon edges.

    `edges` has the columns ordinal, borough, x1, y1, x2, y2. Several features of one
    name stay apart and all count.
    """
    pieces = edges.filter(F.col("y1") != F.col("y2")).withColumn(
        "slab",
        F.explode(
            F.sequence(
                slab_number(F.least("y1", "y2"), height),
                slab_number(F.greatest("y1", "y2"), height),
            )
        ),
    )
    per_shape = pieces.groupBy("slab", "ordinal", "borough").agg(
        F.min(F.least("x1", "x2")).alias("west"),
        F.max(F.greatest("x1", "x2")).alias("east"),
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),
    )
    listed = F.collect_list(F.struct("ordinal", "borough", "west", "east", "edges"))
    reached = F.sequence(cell_number(F.col("west"), width), cell_number(F.col("east"), width))
    return (per_shape.withColumn("cell", F.explode(reached))
            .groupBy("slab", "cell").agg(F.sort_array(listed).alias("shapes")))


def holds(shape: Column, x: Column, y: Column) -> Column:
    """Whether a shape's part of the slab holds the point; most are ruled out by west and east."""
    return x.between(shape["west"], shape["east"]) & contains(shape["edges"], x, y)


class Boroughs:
    """A polygon set prepared for lookups.

    Its index is written once, when it is prepared, and its size counted. A set above
    `broadcast_edges` is joined by shuffle, with hot cells salted.
    """

    def __init__(self, edges: DataFrame, height: float = SLAB_DEGREES,
                 broadcast_edges: int = BROADCAST_EDGES, width: float = CELL_DEGREES):
        self.height, self.width = height, width
        self.index = cut_lineage(cell_index(edges, height, width))
        size = self.index.select(
            F.sum(F.aggregate("shapes", F.lit(0), lambda n, s: n + F.size(s["edges"])))
        ).first()[0]
        self.small = (size or 0) <= broadcast_edges

    def lookup(self, df: DataFrame, longitude: str, latitude: str, out: str,
               null_is_unknown: bool = True) -> DataFrame:
        """Add `out`, the first polygon that holds the point, else "Unknown".

        A missing coordinate gives "Unknown", or NULL if `null_is_unknown` is off.
        """
        x, y = F.col(longitude), F.col(latitude)
        # a point with a NULL or NaN coordinate is in no cell
        known = ~F.isnan(x) & ~F.isnan(y)
        placed = df.withColumns({
            "__slab": F.when(known, slab_number(y, self.height)),
            "__cell": F.when(known, cell_number(x, self.width)),
        })
        index = self.index.select(F.col("slab").alias("__slab"), F.col("cell").alias("__cell"),
                                  "shapes")
        if self.small:
            joined = placed.join(F.broadcast(index), ["__slab", "__cell"], "left")
        else:
            joined = salted_join(placed, index, ["__slab", "__cell"], "left")
        hit = F.get(
            F.filter("shapes", lambda shape: holds(shape, x, y)), F.lit(0)
        )["borough"]
        name = F.coalesce(hit, F.lit("Unknown"))
        if not null_is_unknown:
            name = F.when(x.isNotNull() & y.isNotNull(), name)
        return joined.withColumn(out, name).drop("__slab", "__cell", "shapes")

    def both_ends(self, df: DataFrame, null_is_unknown: bool = True) -> DataFrame:
        """Add pickup_borough and dropoff_borough to trips."""
        df = self.lookup(df, "pickup_longitude", "pickup_latitude", "pickup_borough",
                         null_is_unknown)
        return self.lookup(df, "dropoff_longitude", "dropoff_latitude", "dropoff_borough",
                           null_is_unknown)
