import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare.plans import network as plans


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    found = [(f"v{rng.randrange(14)}", f"v{rng.randrange(14)}") for _ in range(60)]
    hub = [("v0", f"v{i}") for i in range(14)]  # with a self-loop
    return found + hub + found[:10]


def count_triangles(pairs):
    linked = {frozenset(p) for p in pairs if p[0] != p[1]}
    names = sorted({v for p in pairs for v in p})
    return [
        t for t in combinations(names, 3) if all(frozenset(e) in linked for e in combinations(t, 2))
    ]


@pytest.mark.parametrize("limit", [2, 1000])
def test_triangles(spark, pairs, limit):
    expected = count_triangles(pairs)
    edges = graph(spark, pairs)
    found = {tuple(sorted(r)) for r in plans.triangles(edges, limit).collect()}
    assert found == set(expected)
    assert plans.triangles_total(edges, limit).first()[0] == len(expected)
    per_node = plans.triangles_per_node(edges, limit).agg(F.sum("triangle_count")).first()[0]
    assert per_node == 3 * len(expected)


def test_self_loops_make_no_triangle(spark):
    assert plans.triangles_total(graph(spark, [("a", "a"), ("a", "b"), ("b", "a")])).first()[0] == 0


@pytest.mark.parametrize("find", [plans.triangles_total, plans.triangles_per_node, plans.degrees_and_triangles])
def test_no_side_of_a_triangle_join_is_broadcast(spark, pairs, find):
    """But for the salts of hubs, which are few by their definition and joined to the left."""
    found = find(graph(spark, pairs))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftOuter" in line and "__k_" in line for line in joins)
    assert "SortMergeJoin" in plan


def test_wedges(spark, pairs):
    above = {}
    for p in pairs:
        above.setdefault(min(p), set()).add(max(p))
    expected = {}
    for a, neighbours in above.items():
        for b, c in combinations(sorted(neighbours), 2):
            for v in (a, b, c):
                expected[v] = expected.get(v, 0) + 1
    assert dict(rows_of(plans.wedge_count(graph(spark, pairs)))) == expected


def test_degrees(spark):
    found = plans.degrees(graph(spark, [("a", "b"), ("a", "b"), ("b", "b"), ("c", "a")]))
    assert rows_of(found, "node", "out_degree", "in_degree", "total_degree") == [
        ("a", 2, 1, 3), ("b", 1, 3, 4), ("c", 1, 0, 1)
    ]


def test_degree_sums(spark, pairs):
    sums = plans.degrees(graph(spark, pairs)).agg(F.sum("in_degree"), F.sum("out_degree")).first()
    assert tuple(sums) == (len(pairs), len(pairs))


def ranks_of(pairs, rounds, normalize):
    nodes = sorted({v for p in pairs for v in p})
    out = {v: sum(s == v for s, _ in pairs) for v in nodes}
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(rounds):
        new = {v: 0.15 / len(nodes) for v in nodes}
        for s, d in pairs:
            new[d] += 0.85 * rank[s] / (out[s] if normalize else 1)
        rank = new
    return rank


@pytest.mark.parametrize("broadcast", [0, 1000])
@pytest.mark.parametrize("normalize", [True, False])
def test_pagerank(spark, pairs, broadcast, normalize):
    found = plans.pagerank(
        graph(spark, pairs), 4, normalize=normalize, write_every=3, limit=3,
        broadcast_vertices=broadcast,
    )
    assert dict(rows_of(found)) == pytest.approx(ranks_of(pairs, 4, normalize))


def test_edges_stay_where_they_are(spark, pairs):
    """In a round over laid-out edges the ranks are shuffled, the edges are not."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        found = plans.pagerank(graph(spark, pairs), 2, broadcast_vertices=0)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(threshold, before)
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "weight" in line]
    assert len(scans) == 2
    for at in scans:
        join = max(i for i in range(at) if "SortMergeJoin" in lines[i])
        assert "Bucketed: true" in lines[at]
        assert not any("Exchange" in line for line in lines[join:at])


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_names_take_no_part_in_the_rounds(spark, pairs, broadcast):
    """Numbers stand for the airports; their names are joined once, to the last ranks."""
    found = plans.pagerank(graph(spark, pairs), 3, broadcast_vertices=broadcast)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [line for line in lines if "FileScan" in line]
    assert any("src:bigint" in line for line in scans) and not any("src:string" in line for line in scans)
    assert sum("id:string" in line for line in scans) == 1


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_names_that_share_a_number_stay_apart(monkeypatch, spark, pairs, broadcast):
    monkeypatch.setattr(plans, "_number", lambda name: F.length(name).cast("long"))
    found = plans.pagerank(graph(spark, pairs), 4, broadcast_vertices=broadcast)
    assert dict(rows_of(found)) == pytest.approx(ranks_of(pairs, 4, True))


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_flights_from_or_to_an_unknown_airport(spark, broadcast):
    """They count as an airport of their own that passes no rank on."""
    edges = graph(spark, [("a", "b"), ("a", None), (None, "b"), ("b", "a")])
    found = {r["id"]: r["rank"] for r in plans.pagerank(edges, 1, broadcast_vertices=broadcast).collect()}
    base = 0.15 / 3
    assert found == {"a": pytest.approx(base + 0.85 / 3), "b": pytest.approx(base + 0.85 / 6),
                     None: pytest.approx(base + 0.85 / 6)}


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_rounds_end_when_ranks_rest(spark, pairs, broadcast):
    found = plans.pagerank(graph(spark, pairs), 100, write_every=10, broadcast_vertices=broadcast, tolerance=1e-6)
    assert dict(rows_of(found)) == pytest.approx(ranks_of(pairs, 100, True), abs=1e-6)


def test_rank_is_kept_without_dangling_airports(spark):
    ring = [(f"v{i}", f"v{(i + 1) % 5}") for i in range(5)] + [("v0", "v2")]
    total = plans.pagerank(graph(spark, ring)).agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(1.0)


def test_dangling_rank_is_lost(spark):
    total = plans.pagerank(graph(spark, [("a", "b")]), 1).agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(0.15 + 0.85 / 2)


def test_empty_graph(spark):
    assert plans.pagerank(graph(spark, [])).count() == 0
    assert plans.degree_centrality(graph(spark, [])).count() == 0
