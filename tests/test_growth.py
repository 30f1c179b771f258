"""Rows written on the way grow with the graph, not with its square."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from graphstrata.model import HubKind, IndexConfig
from graphstrata.operators import community, paths
from graphstrata.plans.index import build
from graphstrata.plans.live import LiveGraph
from graphstrata.runtime import recorded, shared_dir
from graphstrata.sources.frames import FrameSource
from tests.shapes import graph

N = 120


def written(spark, folders):
    return sum(spark.read.parquet(f).count() for f in folders if os.path.exists(f))  # some are deleted meanwhile


def double_star():
    """Nodes 0 and 1 side by side, each with N leaves."""
    return 2 + 2 * N, [(0, 1)] + [(i % 2, i) for i in range(2, 2 + 2 * N)]


def leaves(spark, *more):
    return spark.createDataFrame([(i, i + 1, *more) for i in range(2, 1 + 2 * N)], "src long, dst long" + (", clusters array<int>" if more else ""))


@pytest.fixture(scope="module")
def stars(spark):
    return graph(spark, double_star())


def test_connecting_leaves_writes_no_neighbours_of_others(spark, stars):
    with recorded() as folders:
        found = paths.connect(stars.adj, leaves(spark), stars.vertices.select("idx")).collect()
    assert sorted((r["step"], r["node"]) for r in found if r["src"] == 2) == [(0, 2), (1, 0), (2, 1), (3, 3)]
    assert len(found) == 4 * (2 * N - 1)
    assert written(spark, folders) < 10 * N


def test_corridors_of_leaves_list_no_members(spark, stars):
    part = stars.vertices.selectExpr("idx", "CAST(idx % 2 AS INT) AS community")
    with recorded() as folders:
        found = paths.evaluate_corridors(stars.adj, part, leaves(spark, [0, 1]).union(spark.createDataFrame([(2, 3, [0]), (4, 4, [0]), (4, 4, [1]), (4, 0, [0])], "src long, dst long, clusters array<int>"))).collect()
    got = {(r["src"], r["dst"], tuple(r["clusters"])): (r["member_count"], r["global_dist"], r["corridor_dist"]) for r in found}
    assert got[2, 3, (0, 1)] == (2 + 2 * N, 3, 3) and got[2, 3, (0,)] == (1 + N, 3, None)
    assert got[4, 4, (0,)] == (1 + N, 0, 0) and got[4, 4, (1,)] == (1 + N, 0, None) and got[4, 0, (0,)] == (1 + N, 1, 1)
    assert len(found) == 2 * N + 3 and written(spark, folders) < 20 * N


def test_two_nodes_alone_hang_on_nothing(spark):
    g = graph(spark, (2, [(0, 1)]))
    assert [r["dist"] for r in paths.distances(g.adj, spark.createDataFrame([(0, 1)], "src long, dst long"), g.vertices.select("idx")).collect()] == [1]
    assert paths.hub_graph(g.adj, g.vertices.select("idx"), 1).count() == 2


def test_hub_edges_are_put_together_as_they_are_read(spark):
    n, edges = double_star()
    nodes = spark.createDataFrame([(str(i), "n", str(i), i) for i in range(n)], "id string, kind string, label string, seq long")
    source = FrameSource(nodes, spark.createDataFrame([(f"{a}-{b}", str(a), str(b), "e") for a, b in edges], "id string, src string, dst string, kind string"))
    halves = spark.createDataFrame([(str(i), i % 2) for i in range(n)], "id string, community int")
    with recorded() as folders:
        index, _ = build(source, IndexConfig(hub_fraction=1.0, hubs=HubKind.DEGREE, k_hop=3), halves)
        assert index.labels.count() == n
        ranked = index.similar(index.assignments.selectExpr("id AS seed"), 5).filter("seed = '2'").orderBy("rank").collect()
    assert [r["id"] for r in ranked] == sorted(str(i) for i in range(0, n, 2) if i != 2)[:5]
    assert index.hub_edges.count() == n * (n - 1)
    assert written(spark, folders) < 40 * n


def test_large_stars_settle_before_the_first_round(spark, monkeypatch):
    monkeypatch.setattr(community, "_ROUNDS", 1)
    monkeypatch.setattr(community, "_LEVELS", 1)
    n, edges = 5 * 9 + 4, [(c, 5 + 8 * c + i) for c in range(5) for i in range(8)] + [(45, 46), (47, 48), (48, 48)]
    found = community.leiden(graph(spark, (n, edges)), use_kernel=False).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["community"], set()).add(r["idx"])
    assert sorted(map(min, groups.values())) == [0, 1, 2, 3, 4, 45, 47]
    assert groups[0] == {0, *range(5, 13)} and {45, 46} in groups.values() and {47, 48} in groups.values()


def test_figures_of_a_cluster_are_made_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i:03}", i % 2) for i in range(N)], "id string, cluster int")
    edges = spark.createDataFrame([("e", "n000", "n002")], "id string, src string, dst string")
    live = LiveGraph.create(spark, str(tmp_path / "live"), rows.select("id"), edges, rows, at=1)
    found = live.same_cluster_figures_as_of(rows.select(F.col("id").alias("seed"), F.lit(1).cast("long").alias("at")), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    assert {(r["seed"], r["n"], r["first"]) for r in found.collect()} == {(f"n{i:03}", N // 2, f"n{i % 2:03}") for i in range(N)}


def test_shared_groups_are_coarsened_without_pairs(spark):
    sets = {0: range(6), 1: [0, 1, 4], 2: [5]}
    members = spark.createDataFrame([(g, i) for g, held in sets.items() for i in held], "group long, idx long")
    part = spark.createDataFrame([(i, i // 2) for i in range(6)], "idx long, community long")
    pairs = [(a, b) for held in sets.values() for a in held for b in held if a != b]
    want = {}
    for a, b in pairs:
        want[a // 2, b // 2] = want.get((a // 2, b // 2), 0) + 1
    with recorded() as folders:
        found = community.coarsen_shared(members, part).collect()
    assert {(r["src"], r["dst"]): r["w"] for r in found} == want
    assert written(spark, folders) == 6


def test_large_stars_that_drifted_settle_before_the_first_round(spark, monkeypatch):
    for name, value in (("KERNEL_NODES", 0), ("_ROUNDS", 1), ("_LEVELS", 1)):
        monkeypatch.setattr(community, name, value)
    hubs, leaves = [f"c{c}" for c in range(4)], [(f"o{i}", f"c{i % 4}") for i in range(24)]
    nodes = spark.createDataFrame([(n, None, i) for i, n in enumerate(hubs + [o for o, _ in leaves])], "id string, label string, seq long")
    edges = spark.createDataFrame([(f"{o}>{c}", o, c) for o, c in leaves], "id string, src string, dst string")
    where = spark.createDataFrame([(h, i) for i, h in enumerate(hubs)] + [(o, int(c[1])) for o, c in leaves], "id string, cluster int")
    live = LiveGraph.create(spark, f"{shared_dir(spark)}/live/{uuid.uuid4().hex}", nodes, edges, where)
    come, gone = spark.createDataFrame([("o0>>c1", "o0", "c1"), ("o2>>c3", "o2", "c3")], "id string, src string, dst string"), spark.createDataFrame([("o0>c0",), ("o2>c2",)], "id string")
    after = live.change(come, gone).recluster(spark.createDataFrame([(c,) for c in range(4)], "cluster int"))
    groups = {}
    for r in after.partition().join(after.nodes(), "idx").collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    expected = {h: {h} for h in hubs}
    for o, c in leaves:
        expected[{"o0": "c1", "o2": "c3"}.get(o, c)].add(o)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_arrivals_are_numbered_once_and_write_no_names_that_nobody_has(spark):
    rows = [(f"n{i:03}", i % 2) for i in range(10)]
    nodes = spark.createDataFrame([(a, "n", a, i) for i, (a, _) in enumerate(rows)], "id string, kind string, label string, seq long")
    source = FrameSource(nodes, spark.createDataFrame([("e", "n000", "n002", "e")], "id string, src string, dst string, kind string"))
    index, _ = build(source, IndexConfig(hub_fraction=1.0, hubs=HubKind.DEGREE), spark.createDataFrame(rows, "id string, community int"))
    there = {r["id"]: r["cluster"] for r in index.assignments.collect()}
    come = [(f"a{i:03}", [f"n{i % 10:03}"] + [f"none{j}" for j in range(9)], i) for i in range(N)]
    with recorded() as folders:
        after, placed = index.insert(spark.createDataFrame(come, "id string, seeds array<string>, seq long"))
        found = {r["id"]: r["cluster"] for r in placed.collect()}
    assert found == {a: there[s[0]] for a, s, _ in come}
    assert [r["id"] for r in after.assignments.orderBy("idx").collect()][10:] == [a for a, _, _ in come]
    assert written(spark, folders) < 8 * N
