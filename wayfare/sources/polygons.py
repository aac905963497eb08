"""Polygon edges from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURES = """
    features array<struct<
        properties: struct<borough: string>,
        geometry: struct<type: string, coordinates: string>
    >>
"""
_RING = "array<array<double>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, borough, x1, y1, x2, y2): one row per edge of every (multi)polygon ring.

    `ordinal` is the feature's place in the file. All features of a name are kept.
    """
    collection = spark.read.schema(_FEATURES).option("multiLine", True).json(path)
    features = collection.select(F.posexplode("features").alias("ordinal", "feature")).select(
        "ordinal",
        F.col("feature.properties.borough").alias("borough"),
        F.col("feature.geometry.type").alias("type"),
        F.col("feature.geometry.coordinates").alias("coordinates"),
    )
    # the two geometry types nest differently: bring both to a list of rings
    rings = F.when(
        F.col("type") == "Polygon", F.from_json("coordinates", f"array<{_RING}>")
    ).otherwise(F.flatten(F.from_json("coordinates", f"array<array<{_RING}>>")))
    ring = features.select("ordinal", "borough", F.explode(rings).alias("ring"))
    return edges_of_rings(ring)


def edges_of_rings(rings: DataFrame) -> DataFrame:
    """Edges between neighbouring points of closed rings `ring array<array<double>>`."""
    starts = F.slice("ring", F.lit(1), F.greatest(F.size("ring") - 1, F.lit(0)))
    return rings.select(
        "ordinal", "borough", "ring", F.posexplode(starts).alias("i", "p")
    ).select(
        F.col("ordinal").cast("int").alias("ordinal"),
        "borough",
        F.col("p")[0].alias("x1"),
        F.col("p")[1].alias("y1"),
        F.get("ring", F.col("i") + 1)[0].alias("x2"),
        F.get("ring", F.col("i") + 1)[1].alias("y2"),
    )
