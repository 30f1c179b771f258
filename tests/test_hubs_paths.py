import pytest

from graphstrata.operators import centrality, community, hubs, paths
from graphstrata.operators.graph import Graph
from graphstrata.plans import catalogue
from graphstrata.sources import edgelist
from tests.shapes import graph, partition, path, star, triangle_chain, two_cliques


def ids(frame):
    return sorted(r["idx"] for r in frame.collect())


def test_hub_fractions(spark):
    g = graph(spark, star(9))
    assert ids(hubs.from_top_fraction(g, 0.0)) == []
    assert len(ids(hubs.from_top_fraction(g, 1.0))) == 10
    assert ids(hubs.from_top_fraction(g, 0.01)) == [0]
    assert ids(hubs.from_top_fraction(g, float("nan"))) == []
    assert hubs._size(100, 0.07) == 8
    assert ids(hubs.from_degree_threshold(g, 3)) == [0]
    assert len(ids(hubs.from_degree_threshold(g, 0))) == 10
    assert ids(hubs.union(hubs.from_indices(g, [3, 1, 3]), hubs.from_indices(g, [1]))) == [1, 3]
    assert hubs.contains(hubs.from_indices(g, [3]), 3)


@pytest.mark.parametrize("arrays", [True, False])
def test_betweenness(spark, arrays):
    scores = {r["idx"]: r["score"] for r in centrality.betweenness(graph(spark, star(5)), 99, use_arrays=arrays).collect()}
    assert scores == {0: 20.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    bridge = {r["idx"]: r["score"] for r in centrality.betweenness(graph(spark, two_cliques(4)), 99, use_arrays=arrays).collect()}
    assert max(bridge, key=bridge.get) == 8
    assert all(r["score"] == 0 for r in centrality.betweenness(graph(spark, path(3)), 0).collect())


def test_bridge_is_a_hub_by_paths_only(spark):
    g = graph(spark, two_cliques(5))
    assert ids(hubs.from_centrality(g, 99, 0.05)) == [10]
    assert ids(hubs.union(hubs.from_top_fraction(g, 0.05), hubs.from_centrality(g, 99, 0.05))) == [0, 10]


def test_sources_are_distinct_and_seeded():
    one = centrality.pick_sources(1000, 50, 7)
    assert one == sorted(set(one)) and len(one) == 50
    assert one == centrality.pick_sources(1000, 50, 7) != centrality.pick_sources(1000, 50, 8)
    assert centrality.pick_sources(5, 9, 1) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(("n", "k", "edges"), [(2, 3, [(0, 1, 1.0), (1, 0, 1.0)]), (3, 3, [(0, 2, 0.5), (2, 0, 0.5)]), (5, 3, []), (3, 0, [])])
def test_hub_graph_of_path_ends(spark, n, k, edges):
    g = graph(spark, path(n))
    found = paths.hub_graph(g.adj, hubs.from_indices(g, [0, n - 1]), k)
    assert sorted((r["src"], r["dst"], r["w"]) for r in found.collect()) == edges


def test_karate_hubs(spark):
    s = edgelist.from_path(spark, "tests/fixtures/karate.txt")
    g = Graph.from_frames(s.nodes(), s.edges())
    top = hubs.from_top_fraction(g, 0.10)
    assert {g.node_id(i) for i in ids(top)} >= {"1", "34"} and len(ids(top)) == 4
    met = paths.hub_graph(g.adj, top, 3)
    assert met.count() == 12


def corridor(spark, shape, split):
    g, p = graph(spark, shape), partition(spark, split)
    return g, p, community.cluster_adjacency(g.adj, p), p.selectExpr("community cluster").distinct()


def test_corridors(spark, monkeypatch):
    g, p, near, names = corridor(spark, triangle_chain(3), [0, 0, 0, 1, 1, 1, 2, 2, 2])
    assert paths.cluster_corridor(near, names, 0, 2) == [0, 1, 2]
    assert paths.cluster_corridor(near, names, 1, 1) == [1]
    assert paths.cluster_corridor(near, names, 0, 9) is None
    whole = paths.evaluate_corridor(g.adj, p, [0, 1, 2], 1, 7)
    assert (whole.member_count, whole.optimal) == (9, True)
    assert not paths.evaluate_corridor(g.adj, p, [0, 2], 1, 7).connected
    many = paths.evaluate_corridors(g.adj, p, spark.createDataFrame([(1, 7, [0, 1, 2]), (1, 7, [0, 2]), (1, 4, [0, 1])], "src long, dst long, clusters array<int>"))
    assert sorted((r["member_count"], r["corridor_dist"]) for r in many.collect() if r["corridor_dist"]) == [(6, 3), (9, 4)]
    monkeypatch.setattr(paths, "_DRIVER_CLUSTERS", 0)
    assert paths.cluster_corridor(near, names, 0, 2) == [0, 1, 2]


def test_no_corridor_without_a_bridge(spark):
    g, p, near, names = corridor(spark, triangle_chain(2, bridges=False), [0, 0, 0, 1, 1, 1])
    assert paths.cluster_corridor(near, names, 0, 1) is None
    assert paths.evaluate_corridor(g.adj, p, [0, 1], 1, 4) is None
    assert paths.bfs_distance(g.adj, p.select("idx"), 1, 1) == 0


def test_corridors_of_all_nations_of_the_region(spark, tmp_path):
    nations = 28
    tables = {
        "region": ([(r, f"r{r}") for r in range(5)], "r_regionkey long, r_name string"),
        "nation": ([(n, f"n{n}", 1) for n in range(nations)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(1, "c", 0)], "c_custkey long, c_name string, c_nationkey long"),
        "supplier": ([(1, "s", 1)], "s_suppkey long, s_name string, s_nationkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(tuple(r) for r in catalogue.cluster_corridor(spark, str(tmp_path)).collect())
    assert got == [(a + 5, b + 5, i, c) for a in range(nations) for b in range(a + 1, nations) for i, c in enumerate((a + 5, 1, b + 5))]


def test_plans_of_hubs_and_searches(spark):
    g = graph(spark, two_cliques(5))
    plan = hubs.from_top_fraction(g, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    assert "Aggregate" not in paths.simple(g.adj)._jdf.queryExecution().optimizedPlan().toString()


def test_hub_graph_accessors(spark):
    g = graph(spark, path(5))
    found = paths.HubGraph.build(g.adj, hubs.from_indices(g, [0, 2, 4]), 2)
    assert (found.hub_count(), found.edge_count(), found.is_empty()) == (3, 4, False) and found.contains(2) and not found.contains(1)
    assert [tuple(r) for r in found.neighbors(2).collect()] == [(0, 2, 0.5), (4, 2, 0.5)]
    assert [r["idx"] for r in found.iter_hubs().collect()] == [0, 2, 4]
    assert paths.HubGraph.build(g.adj, hubs.from_indices(g, [0, 4]), 3).edge_count() == 0


def test_partition_and_region_accessors(spark):
    p = partition(spark, [0, 0, 1, 1])
    assert (community.community_of(p, 2), community.community_of(p, 9), community.community_count(p)) == (1, None, 2)
    r = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "cluster int, region int")
    assert (community.region_of_cluster(r, 2), community.region_of_cluster(r, 7), community.region_count(r)) == (1, None, 2)
    assert {x["region"]: x["clusters"] for x in community.clusters_by_region(r).collect()} == {0: [0, 1], 1: [2]}


def plain_betweenness(n, edges, sources):
    near = [sorted({b for a, b in edges if a == u} | {a for a, b in edges if b == u}) for u in range(n)]
    score = [0.0] * n
    for s in sources:
        dist, sigma, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v], sigma[v] = dist[u] + 1, 0.0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                score[v] += delta[v]
    return score


#: Users 0 to 11 of types 12 to 14, in classes; a tail; a pair alone; a node alone.
MIXED = 21, [(u, 12 + t) for u in range(12) for t in range(3) if (u % 4 + 1) >> t & 1] + [(0, 15), (15, 16), (16, 17), (18, 19)]


@pytest.mark.parametrize("arrays", [True, False])
@pytest.mark.parametrize("samples", [99, 5])
def test_betweenness_of_twins_is_that_of_each(spark, arrays, samples):
    n, edges = MIXED
    got = {r["idx"]: r["score"] for r in centrality.betweenness(graph(spark, MIXED), samples, 7, use_arrays=arrays).collect()}
    expected = [x * n / min(samples, n) for x in plain_betweenness(n, edges, centrality.pick_sources(n, samples, 7))]
    assert [got[i] for i in range(n)] == pytest.approx(expected)


def test_twins_are_searched_from_once(spark, monkeypatch):
    g, searched = graph(spark, (2003, [(u, 2000 + t) for u in range(2000) for t in range(3)])), []
    monkeypatch.setattr(centrality, "_by_arrays", lambda near, classes: searched.append(classes.count()) or classes.selectExpr("idx", "0.0D AS score"))
    centrality.betweenness(g, 1 << 20)
    assert searched == [2]


def test_many_samples_are_not_drawn_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(centrality, "DRAWN", 3)
    found = [r["idx"] for r in centrality._chosen(graph(spark, star(40)).vertices, 41, 10, 7).collect()]
    assert len(found) == len(set(found)) == 10 and set(found) <= set(range(41))


def test_exact_betweenness_of_a_million_nodes_is_not_sampled(spark, tmp_path):
    """Users of one type each but for one of both: users lie on the one's paths only, and types on those of their own users."""
    half = (1 << 19) + 1
    spark.range(2 * half + 1).selectExpr("id AS user_id", f"explode(IF(id = {2 * half}, array('a', 'b'), IF(id < {half}, array('a'), array('b')))) AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    found = {r["id"]: r["score"] for r in catalogue.betweenness_exact(spark, str(tmp_path)).filter("score > 0").collect()}
    own = 2 * half * (half + 2) + half * (half - 1)  # ways between a type's users and all beyond, and among them
    assert found == {"type:a": own, "type:b": own, f"user:{2 * half}": 2 * (half + 1) ** 2}
