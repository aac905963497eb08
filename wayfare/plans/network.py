"""Measures of a directed multigraph given as edges (src, dst), one row per flight."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.ranking import top_k
from wayfare.operators.skew import (
    GROUP_ROWS,
    join_spread,
    salted_join,
    salts_of,
    spread_rows,
)
from wayfare.session import cut_lineage, laid_out

# Ranks of this many airports are a broadcast of some 50 MB.
BROADCAST_VERTICES = 1_000_000

# Weighted edges in a bucket of the shuffled PageRank, some 50 MB.
BUCKET_EDGES = 1_000_000


def vertices(edges: DataFrame) -> DataFrame:
    """Every airport that a flight leaves or reaches."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    """(component, count) for vertices and edges."""
    n_vertices = vertices(edges).agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("vertices").alias("component"), "count"
    )
    n_edges = edges.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("edges").alias("component"), "count"
    )
    return n_vertices.unionByName(n_edges)


def degrees(edges: DataFrame) -> DataFrame:
    """Flights in, out and in total per airport; parallel flights all count."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return (
        ends.groupBy("node")
        .agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        .withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))
    )


def degree_centrality(edges: DataFrame) -> DataFrame:
    """total_degree / (airports - 1); parallel flights can bring it above 1."""
    found = degrees(edges)
    others = found.agg((F.count(F.lit(1)) - 1).alias("others")).scalar()
    return found.select(
        "node", F.try_divide(F.col("total_degree"), others).alias("degree_centrality")
    )


def most_central(edges: DataFrame, k: int = 10) -> DataFrame:
    return top_k(degree_centrality(edges), k, F.desc("degree_centrality"), F.asc("node"))


def hubs(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k airports with the most flights."""
    return top_k(degrees(edges), k, F.desc("total_degree"), F.asc("node"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs u < v that some flight connects; no self-loops."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .distinct()
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """The neighbour set of every airport as rows (id, neighbour), so a hub is never one row."""
    return undirected(edges).select(
        F.inline(
            F.array(
                F.struct(F.col("u").alias("id"), F.col("v").alias("neighbour")),
                F.struct(F.col("v").alias("id"), F.col("u").alias("neighbour")),
            )
        )
    )


def _successors(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Successor lists (low, successors), numbers of the airports, and the salts of hubs by number.

    Pairs are directed from the lower to the higher (degree, number), and lists are in that order. In
    that direction no vertex has more than sqrt(2 x pairs) successors, so a list is bounded by itself.
    Numbers are given as the degrees are written, and stay. A vertex has at most its degree in rows on
    either side, so one table of high degrees tells every join which keys to divide. Both sides of a
    join grow with the graph, and compress well: no size on disk may make one a broadcast.
    """
    pairs = cut_lineage(undirected(edges))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    degree = cut_lineage(ends.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
                         .withColumn("number", F.monotonically_increasing_id()))
    hot = degree.filter(F.col("rows") > limit)

    def ranked(df, column):
        found = degree.select(F.col("id").alias(column), F.struct("rows", "number").alias(f"__{column}"))
        salts = salts_of(hot.withColumnRenamed("id", column), [column], limit)
        return salted_join(df, found, [column], salts=salts, hint="merge")

    both = ranked(ranked(pairs, "u"), "v")
    directed = both.select(F.least("__u", "__v")["number"].alias("low"),
                           F.greatest("__u", "__v").alias("high"))
    lists = directed.groupBy("low").agg(F.sort_array(F.collect_list("high"))["number"].alias("successors"))
    return (cut_lineage(lists), degree.select("number", "id"),
            salts_of(hot.withColumnRenamed("number", "b"), ["b"], limit))


def _closed(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, third): per directed pair the successors that both ends share; and the numbers.

    Every pair carries what follows its higher end in the list of its lower end to the list of the
    higher end, where the two are intersected. No path of two pairs is ever a row.
    """
    lists, numbers, salts = _successors(edges, limit)
    pairs = lists.select("low", "successors", F.posexplode("successors").alias("at", "b")).filter(
        F.col("at") < F.size("successors") - 1).select(
        F.col("low").alias("a"), "b",
        F.slice("successors", F.col("at") + 2, F.size("successors")).alias("of_a"))
    of_b = lists.select(F.col("low").alias("b"), F.col("successors").alias("of_b"))
    met = salted_join(pairs, of_b, ["b"], salts=salts, hint="merge")
    return met.select("a", "b", F.array_intersect("of_a", "of_b").alias("third")), numbers


def triangles(edges: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Every triangle of the undirected graph once, as (a, b, c)."""
    closed, numbers = _closed(edges, limit)
    found = closed.select("a", "b", F.explode("third").alias("c"))
    for corner in ("a", "b", "c"):
        names = numbers.select(F.col("number").alias(corner), F.col("id").alias(f"__{corner}"))
        found = found.join(names.hint("merge"), corner)
    return found.select(*[F.col(f"__{corner}").alias(corner) for corner in ("a", "b", "c")])


def triangles_total(edges: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    closed, _ = _closed(edges, limit)
    total = F.coalesce(F.sum(F.size("third")), F.lit(0))
    return closed.agg(total.cast("bigint").alias("triangles"))


def triangles_per_node(edges: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """(node, triangle_count) of airports that are in a triangle."""
    closed, numbers = _closed(edges, limit)
    n = F.size("third").cast("bigint")
    corners = F.concat(
        F.array(F.struct(F.col("a").alias("number"), n.alias("n")),
                F.struct(F.col("b").alias("number"), n.alias("n"))),
        F.transform("third", lambda c: F.struct(c.alias("number"), F.lit(1).cast("bigint").alias("n"))))
    counted = (closed.filter(F.size("third") > 0).select(F.inline(corners))
               .groupBy("number").agg(F.sum("n").alias("triangle_count")))
    return counted.join(numbers.hint("merge"), "number").select(F.col("id").alias("node"), "triangle_count")


def degrees_and_triangles(edges: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Degrees with the triangle count, 0 without one."""
    return (
        degrees(edges)
        .join(triangles_per_node(edges, limit).hint("merge"), "node", "left")
        .fillna(0, subset=["triangle_count"])
        .orderBy(F.desc("total_degree"), F.asc("node"))
    )


def wedge_count(edges: DataFrame) -> DataFrame:
    """Per airport, the pairs of neighbours it takes part in at their least common airport.

    A pair (b, c) of neighbours above a, b < c, counts for a, b and c, whether or not b and
    c are connected. With k neighbours above a there are k(k-1)/2 pairs for a and k-1 for
    each neighbour, so no pair has to be written out. Self-loops make an airport a
    neighbour of itself here.
    """
    pairs = edges.select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).distinct()
    above = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    as_apex = above.select(F.col("a").alias("node"), (F.col("k") * (F.col("k") - 1) / 2)
                           .cast("bigint").alias("n"))
    as_end = salted_join(pairs, above, ["a"]).select(
        F.col("b").alias("node"), (F.col("k") - 1).alias("n")
    )
    return (
        as_apex.unionByName(as_end)
        .groupBy("node")
        .agg(F.sum("n").alias("wedge_count"))
        .filter(F.col("wedge_count") > 0)
    )


def _number(name: str) -> Column:
    """A 64-bit number that stands for an airport; NULL stays NULL."""
    return F.when(F.col(name).isNotNull(), F.xxhash64(name))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, normalize: bool = True,
             write_every: int = 5, limit: int = GROUP_ROWS,
             broadcast_vertices: int = BROADCAST_VERTICES, tolerance: float | None = None) -> DataFrame:
    """(id, rank) after a fixed number of rounds, from equal ranks.

    With a `tolerance` the rounds end earlier if the ranks of all airports together moved by no more in
    a round; that is looked at when ranks are written, every `write_every` rounds.

    A flight passes its origin's rank, divided by the origin's flights, to its
    destination; with normalize=False it passes the whole rank. Rank of airports that no
    flight leaves is lost, not spread.

    The ranks of up to `broadcast_vertices` airports travel to the edges. The edges of a larger graph are
    laid out once, in buckets of origin and salt, so that a round shuffles ranks alone.

    Airports go by hashed numbers, a fraction of their names' bytes in every round. Should two names
    share a number, the names themselves are used.
    """
    names = cut_lineage(vertices(edges).withColumn("number", _number("id")))
    n, named, numbers = names.agg(
        F.count(F.lit(1)), F.count("id"), F.count_distinct("number")).first()
    if n == 0:
        return names.select("id", F.lit(0.0).alias("rank"))
    if numbers == named:
        edges = edges.select(_number("src").alias("src"), _number("dst").alias("dst"))
    else:
        names = names.withColumn("number", F.col("id"))
    nodes = names.select(F.col("number").alias("id"))

    def with_names(ranks):
        known = names.select(F.col("id").alias("name"), "number").hint("merge")
        return ranks.join(known, F.col("id").eqNullSafe(F.col("number"))).select(F.col("name").alias("id"), "rank")

    # parallel flights become one weighted edge, whose weight is 1 / flights of the origin
    parallel = cut_lineage(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("flights")))
    small = n <= broadcast_vertices
    pairs = None if small else parallel.count()

    leaving = parallel.groupBy("src").agg(
        F.sum("flights").alias("out"), F.count(F.lit(1)).alias("rows")
    )
    if not small:
        leaving = cut_lineage(leaving)
        salts = cut_lineage(salts_of(leaving.filter(F.col("rows") > limit), ["src"], limit))
        parallel = spread_rows(parallel, ["src"], salts)

    def with_origin(df, table):
        """Edges with a table of one row per origin; the salt of the edges stays."""
        if small:
            return df.join(F.broadcast(table), "src")
        return join_spread(df, salts, table, ["src"], keep_salt=True)

    weight = F.col("flights").cast("double")
    if normalize:
        parallel = with_origin(parallel, leaving.select("src", "out"))
        weight = weight / F.col("out")
    salt = [] if small else ["__salt"]
    weighted = parallel.select("src", "dst", weight.alias("weight"), *salt)
    if small:
        weighted = cut_lineage(weighted)
    else:
        number = max(nodes.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / BUCKET_EDGES))
        weighted = laid_out(weighted, ["src", "__salt"], number)
    base = F.lit((1.0 - damping) / n)
    nothing = nodes.select("id", F.lit(0.0).alias("passed"))

    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        joined = with_origin(weighted, ranks.withColumnRenamed("id", "src"))
        passed = joined.select(
            F.col("dst").alias("id"), (F.col("rank") * F.col("weight")).alias("passed")
        )
        ends = i % write_every == 0 and i < rounds
        if ends and tolerance is not None:
            kept = ranks.select("id", F.lit(0.0).alias("passed"), F.col("rank").alias("before"))
            passed = passed.withColumn("before", F.lit(None).cast("double"))
        else:
            kept = nothing
        # a zero for every airport keeps those that no flight reaches, without a join
        sums = passed.unionByName(kept).groupBy("id").agg(
            F.sum("passed").alias("passed"), *[F.max(c).alias(c) for c in kept.columns[2:]])
        ranks = sums.select("id", (F.lit(damping) * F.col("passed") + base).alias("rank"), *kept.columns[2:])
        if ends:
            ranks = cut_lineage(ranks)
        if ends and tolerance is not None:
            if ranks.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] <= tolerance:
                return with_names(ranks)
            ranks = ranks.select("id", "rank")
    return with_names(ranks)
