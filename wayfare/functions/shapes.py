"""Point in polygon by the even-odd rule over an array of edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crosses(edge: Column, x: Column, y: Column) -> Column:
    """Does a ray going east from (x, y) cross `edge<x1,y1,x2,y2>`? Never for flat edges."""
    spans = (edge["y1"] > y) != (edge["y2"] > y)
    slope = F.try_divide(edge["x2"] - edge["x1"], edge["y2"] - edge["y1"])
    return spans & (x < slope * (y - edge["y1"]) + edge["x1"])


def contains(edges: Column, x: Column, y: Column) -> Column:
    """True when (x, y) lies in the region bounded by `edges`; holes work by themselves."""
    return F.size(F.filter(edges, lambda edge: crosses(edge, x, y))) % 2 == 1
