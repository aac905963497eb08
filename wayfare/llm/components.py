"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import written
from wayfare.operators.skew import GROUP_ROWS, salted_join, salts_of


def _with_least(edges: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """Edges with the least neighbour `m` of their `u`; edges of a hub are spread over several tasks."""
    hot = least.filter(F.col("rows") > limit)
    return salted_join(edges, least.select("u", "m"), ["u"], salts=salts_of(hot, ["u"], limit))


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = GROUP_ROWS) -> DataFrame:
    """(node, root) for every node with an edge; the root is the smallest node of its component.

    Each round hands every node's neighbours to the smallest one it knows; a round sums up before it
    shuffles, its edges are written, and no list of neighbours is ever formed. Nodes of more than
    `limit` edges are salted in joins. Self-loops and repeated edges do no harm; an empty table gives
    an empty one.
    """
    now = written(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")
        least = both.groupBy("u").agg(*near).withColumn("m", F.least("u", "m"))
        large = _with_least(both.filter("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        least = large.groupBy("u").agg(*near)
        small = _with_least(large, least, limit).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
