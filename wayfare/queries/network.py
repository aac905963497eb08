"""Flight-network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.plans import network as plans
from wayfare.queries.base import ROUTES, ctes, query, stable, stable_sql
from wayfare.sources import derived

DEGREES = """ends AS (
    SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges),
    degrees AS (SELECT node, CAST(sum(o) AS BIGINT) AS out_degree,
        CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS total_degree
        FROM ends GROUP BY node)"""
NODES = "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
PAIRS = """pairs AS (
    SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst)"""
TRIANGLES = f"""{PAIRS}, triangles AS (
    SELECT e1.u AS a, e1.v AS b, e2.v AS c FROM pairs e1
    JOIN pairs e2 ON e1.v = e2.u JOIN pairs e3 ON e3.u = e1.u AND e3.v = e2.v),
    per_node AS (SELECT node, count(*) AS triangle_count FROM (
        SELECT unnest([a, b, c]) AS node FROM triangles) GROUP BY node)"""


def _edges(spark, sf_dir):
    return derived.flight_routes(spark, sf_dir)


@query("graph_stats", ctes(ROUTES, NODES) + """
    SELECT 'vertices' AS component, count(*) AS count FROM nodes
    UNION ALL SELECT 'edges', count(*) FROM edges""")
def graph_stats(spark, sf_dir):
    return plans.graph_stats(_edges(spark, sf_dir))


@query("vertices", ctes(ROUTES, NODES) + "SELECT id FROM nodes")
def vertices(spark, sf_dir):
    return plans.vertices(_edges(spark, sf_dir))


@query("edge_ends", ctes(ROUTES) + """
    SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)
    GROUP BY id""")
def edge_ends(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    ends = edges.select(F.col("src").alias("id")).unionByName(
        edges.select(F.col("dst").alias("id"))
    )
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("degrees", ctes(ROUTES, DEGREES) + "SELECT * FROM degrees")
def degrees(spark, sf_dir):
    return plans.degrees(_edges(spark, sf_dir))


@query("undirected_edges", ctes(ROUTES, PAIRS) + "SELECT u, v FROM pairs")
def undirected_edges(spark, sf_dir):
    return plans.undirected(_edges(spark, sf_dir))


@query("neighbours", ctes(ROUTES, PAIRS) + """
    SELECT u AS id, v AS neighbour FROM pairs UNION ALL SELECT v, u FROM pairs""")
def neighbours(spark, sf_dir):
    return plans.neighbours(_edges(spark, sf_dir))


@query("triangles_total", ctes(ROUTES, TRIANGLES) + "SELECT count(*) AS triangles FROM triangles")
def triangles_total(spark, sf_dir):
    return plans.triangles_total(_edges(spark, sf_dir))


@query("triangles_per_node", ctes(ROUTES, TRIANGLES) + "SELECT * FROM per_node")
def triangles_per_node(spark, sf_dir):
    return plans.triangles_per_node(_edges(spark, sf_dir))


@query("degrees_and_triangles", ctes(ROUTES, DEGREES, TRIANGLES) + """
    SELECT d.*, coalesce(p.triangle_count, 0) AS triangle_count
    FROM degrees d LEFT JOIN per_node p USING (node)""")
def degrees_and_triangles(spark, sf_dir):
    return plans.degrees_and_triangles(_edges(spark, sf_dir))


@query("wedge_count", ctes(ROUTES) + """, loose AS (
    SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges),
    wedges AS (SELECT e.a, e.b, n.b AS c FROM loose e JOIN loose n ON e.a = n.a AND e.b < n.b)
    SELECT node, count(*) AS wedge_count FROM (SELECT unnest([a, b, c]) AS node FROM wedges)
    GROUP BY node""")
def wedge_count(spark, sf_dir):
    return plans.wedge_count(_edges(spark, sf_dir))


CENTRALITY = """central AS (
    SELECT node, total_degree / CAST((SELECT count(*) - 1 FROM degrees) AS DOUBLE)
        AS degree_centrality FROM degrees)"""


@query("degree_centrality", ctes(ROUTES, DEGREES, CENTRALITY) + "SELECT * FROM central")
def degree_centrality(spark, sf_dir):
    return plans.degree_centrality(_edges(spark, sf_dir))


@query("most_central", ctes(ROUTES, DEGREES, CENTRALITY) + """
    SELECT * FROM central ORDER BY degree_centrality DESC, node LIMIT 10""")
def most_central(spark, sf_dir):
    return plans.most_central(_edges(spark, sf_dir))


@query("hubs", ctes(ROUTES, DEGREES) + """
    SELECT * FROM degrees ORDER BY total_degree DESC, node LIMIT 10""")
def hubs(spark, sf_dir):
    return plans.hubs(_edges(spark, sf_dir))


def _rounds_sql(weight: str, rounds: int = 10) -> str:
    parts = [
        ROUTES, NODES.replace("AS (", "AS MATERIALIZED (", 1),
        "n AS (SELECT count(*) AS n FROM nodes)",
        f"""weighted AS MATERIALIZED (
            SELECT src, dst, {weight} AS w FROM (
                SELECT src, dst, count(*) AS flights FROM edges GROUP BY src, dst)
            JOIN (SELECT src, count(*) AS out FROM edges GROUP BY src) USING (src))""",
        "r0 AS (SELECT id, 1e0 / (SELECT n FROM n) AS rank FROM nodes)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"""r{i} AS MATERIALIZED (
            SELECT v.id, 0.85e0 * coalesce(p.s, 0e0) + (1e0 - 0.85e0) / (SELECT n FROM n) AS rank
            FROM nodes v LEFT JOIN (SELECT w.dst, sum(r.rank * w.w) AS s
                FROM weighted w JOIN r{i - 1} r ON w.src = r.id GROUP BY w.dst) p
            ON v.id = p.dst)""")
    return ctes(*parts)


@query("pagerank", _rounds_sql("flights / CAST(out AS DOUBLE)") + f"""
    SELECT id, {stable_sql('rank', 12)} AS rank FROM r10""")
def pagerank(spark, sf_dir):
    return plans.pagerank(_edges(spark, sf_dir)).select("id", stable("rank", 12).alias("rank"))


@query("pagerank_laid_out", _rounds_sql("flights / CAST(out AS DOUBLE)") + f"""
    SELECT id, {stable_sql('rank', 12)} AS rank FROM r10""")
def pagerank_laid_out(spark, sf_dir):
    """The way of a graph whose ranks are too many to broadcast: edges in buckets."""
    ranks = plans.pagerank(_edges(spark, sf_dir), broadcast_vertices=0)
    return ranks.select("id", stable("rank", 12).alias("rank"))


# un-normalized ranks grow by orders of magnitude: compare the leading digits of the logarithm
@query("pagerank_unnormalized", _rounds_sql("CAST(flights AS DOUBLE)") + f"""
    SELECT id, {stable_sql('ln(rank)', 9)} AS log_rank FROM r10""")
def pagerank_unnormalized(spark, sf_dir):
    ranks = plans.pagerank(_edges(spark, sf_dir), normalize=False)
    return ranks.select("id", stable(F.log("rank"), 9).alias("log_rank"))
