import json

import pytest

from graphstrata.cli import main
from graphstrata.model import ClusterDrift, CorruptionError, DriftReport, DuplicateNodeError, HubKind, IndexConfig, NeverRebalance, UnsupportedFormatError
from graphstrata.plans import index as plans
from graphstrata.plans.index import Index, LabelledResult, SameCluster, Similar, build
from graphstrata.sources import edgelist
from graphstrata.sources.frames import pair_source
from graphstrata.streaming.inserts import stream_inserts
from tests.shapes import TWO_TRIANGLES, two_cliques


@pytest.fixture(scope="module")
def triangles(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("triangles"))
    index, stats = build(pair_source(spark, *TWO_TRIANGLES), path=path)
    return index, stats, path


def test_build(triangles):
    index, stats, _ = triangles
    assert (stats.nodes, stats.clusters, stats.regions, stats.hubs) == (6, 2, 2, 1)
    assert index.query_same_cluster("0000").ids == ["0000", "0001", "0002"]
    assert index.query_same_cluster("0000").stats.clusters_visited == 1
    assert index.query_same_cluster("none").ids == []
    assert (index.cluster_of("none"), index.region_of("none"), index.is_hub("none"), index.hub_neighbors("none")) == (None, None, False, [])
    assert index.query_similar("0000", 0).ids == [] and index.query_similar("none", 5).stats.clusters_visited == 0
    assert index.query_similar("0000", 1).ids == ["0001"]
    assert [r["label"] for r in index.same_cluster_by_label(["node_0"]).orderBy("rank").collect()] == ["node_0", "node_1", "node_2"]
    assert index.same_cluster_by_label(["nobody"]).count() == 0
    assert (index.label_of("0003"), index.id_of_label("node_3")) == ("node_3", "0003")
    assert index.cluster_members(0) == ["0000", "0001", "0002"] and index.cluster_members(9) is None
    assert index.cluster_meta(9) is None and index.cluster_drift(9) == ClusterDrift(0, 0)


def test_inserts(spark, triangles):
    index, _, _ = triangles
    memory = Index(spark, index.tables)
    after, placed = memory.insert(
        spark.createDataFrame([("n1", ["0000", "0001"], 0), ("n2", ["0000", "0003"], 1), ("n3", ["x"], 2), ("n4", None, 3), ("n5", ["n3"], 4)], "id string, seeds array<string>, seq long")
    )
    assert {r["id"]: r["cluster"] for r in placed.collect()} == {"n1": 0, "n2": 0, "n3": 2, "n4": 3, "n5": 2}
    assert after.cluster_meta(0)[0] == 5 and after.cluster_meta(2) == (2, 0)
    assert after.drift_report().total_inserts == 5 and after.drift_report().clusters[0] == ClusterDrift(0, 2)
    assert after.maintain(NeverRebalance()).actions_taken == []
    for again in ("0000", "n1"):
        with pytest.raises(DuplicateNodeError):
            after.insert_node(again, [])
    bulk, placed = memory.insert(spark.createDataFrame([("m1", ["0003"]), ("m2", ["m1"])], "id string, seeds array<string>"), order_insensitive=True)
    assert {r["id"]: r["cluster"] for r in placed.collect()} == {"m1": 1, "m2": 2}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "index")
    assert Index.open(spark, path).stats() == {"nodes": 0, "clusters": 0, "hubs": 0}
    build(pair_source(spark, *TWO_TRIANGLES), path=path)
    grown, cluster = Index.open(spark, path).insert_node("new", ["0004"])
    again = Index.open(spark, path)
    assert again.cluster_of("new") == cluster == 1 and again.cluster_drift(1).delta_inserts == 1
    assert "new" in again.query_same_cluster("new").ids
    build(pair_source(spark, 3, [(0, 1), (1, 2), (0, 2)]), path=path)
    small = Index.open(spark, path)
    assert small.stats()["nodes"] == 3 and small.cluster_of("new") is None and small.drift_report().total_inserts == 0
    meta = tmp_path / "index" / (tmp_path / "index" / "CURRENT").read_text() / "_meta.json"
    crc = meta.parent / f".{meta.name}.crc"
    crc.unlink(missing_ok=True)
    meta.write_text(json.dumps({"format_version": 99}))
    with pytest.raises(UnsupportedFormatError):
        Index.open(spark, path)
    meta.write_text("")
    with pytest.raises(CorruptionError):
        Index.open(spark, path)


def test_ordered_inserts_see_what_came_before(spark):
    index, _ = build(pair_source(spark, *TWO_TRIANGLES))
    where = {r["id"]: r["cluster"] for r in index.assignments.collect()}
    rows = [("a", ["0000"], 0), ("b", ["c"], 1), ("c", ["none"], 2), ("d", ["c", "b", "c"], 3), ("e", ["0005", "a"], 4), ("f", None, 5), ("g", ["f", "d", "e"], 6), ("h", ["i"], 7), ("i", ["h", "a", "h"], 8), ("j", ["i", "g"], 9)]
    want, fresh = dict(where), max(where.values()) + 1
    for name, seeds, _ in rows:
        votes = [want[s] for s in seeds or [] if s in want]
        want[name] = min(votes, key=lambda c: (-votes.count(c), c)) if votes else fresh
        fresh += not votes
    _, placed = index.insert(spark.createDataFrame(rows[::-1], "id string, seeds array<string>, seq long"))
    assert {r["id"]: r["cluster"] for r in placed.collect()} == {name: want[name] for name, _, _ in rows}


def test_hub_strategies(spark):
    source = pair_source(spark, *two_cliques(4))
    both, _ = build(source)
    assert both.is_hub("0008") and both.is_hub("0000")
    degree, stats = build(source, IndexConfig(hubs=HubKind.DEGREE))
    assert stats.hubs == 1 and not degree.is_hub("0008")


def test_karate_expands_over_hubs(spark):
    index, stats = build(edgelist.from_path(spark, "tests/fixtures/karate.txt"))
    assert (stats.nodes, stats.clusters, stats.hubs) == (34, 4, 4)
    found = index.query_similar("1", 33)
    assert found.stats.clusters_visited >= 2 and found.stats.hubs_visited > 0
    assert "1" not in found.ids and len(set(found.ids)) == len(found.ids)


def test_drift_report_sums():
    report = DriftReport({0: ClusterDrift(0, 10), 1: ClusterDrift(0, 25), 2: ClusterDrift(1, 0)})
    assert (report.cluster_count, report.total_inserts) == (3, 35)


def test_stream_of_inserts(spark, tmp_path):
    path = str(tmp_path / "index")
    build(pair_source(spark, *TWO_TRIANGLES), path=path)
    schema = "id string, seeds array<string>, seq long"
    spark.createDataFrame([("s1", ["0000"], 0), ("s2", ["s1"], 1)], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream_inserts(spark, path, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
    assert Index.open(spark, path).cluster_meta(0)[0] == 5


def test_command_line(spark, tmp_path, capsys):
    dump, to = tmp_path / "d.sql", str(tmp_path / "index")
    dump.write_text("CREATE TABLE `a` (`i` int);\nCREATE TABLE `b` (\n `i` int,\n FOREIGN KEY (`i`) REFERENCES `a` (`i`)\n);\nCREATE TABLE `c` (`i` int);\n")
    for argv in (["build", "--from-sql", str(dump), "--to", to], ["info", "--index", to], ["similar", "a", "--index", to], ["similar", "zz", "--index", to], ["similar", "c", "--index", to], ["same-cluster", "a", "--index", to], ["clusters", "--index", to, "--min-size", "2"], ["drift", "--index", to], ["tables", "--index", to, "--grep", "c"]):
        assert main(argv, spark) == 0
    out = capsys.readouterr().out
    for line in ("3 tables, 1 foreign keys, 0 routine pairs, 1 edges", "nodes: 3", "zz is not in the index", "c has no neighbours", "total: 0"):
        assert line in out
    assert ": 2 nodes, 1 hubs: a, b" in out or ": 2 nodes, 2 hubs: a, b" in out or ": 2 nodes, 0 hubs: a, b" in out


def test_questions_by_kind_and_label(triangles):
    index, _, _ = triangles
    assert index.query(SameCluster("0000")) == index.query_same_cluster("0000") and index.query(Similar("0000", 2)) == index.query_similar("0000", 2)
    assert index.query_by_label(SameCluster("node_0")).labels == ["node_0", "node_1", "node_2"]
    assert index.query_by_label(Similar("node_0", 1)).labels == ["node_1"] and index.query_by_label(Similar("node_0", 1)).stats.clusters_visited == 1
    assert index.query_by_label(SameCluster("nobody")) == LabelledResult.empty() == index.query_by_label(Similar("nobody", 3))


def test_inserts_append_to_snapshots(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    build(pair_source(spark, *TWO_TRIANGLES), IndexConfig(hub_fraction=0.3), path=path)
    before = Index.open(spark, path).meta["folders"]
    Index.open(spark, path).insert_node("n0", ["0000"])
    index = Index.open(spark, path)
    assert index.meta["folders"]["assignments"][:1] == before["assignments"] and index.meta["folders"]["hub_edges"] == before["hub_edges"]
    added = spark.read.parquet(f"{path}/{index.meta['folders']['assignments'][1]}")
    assert [r["id"] for r in added.collect()] == ["n0"] and index.meta["config"]["hub_fraction"] == 0.3
    monkeypatch.setattr(plans, "MOST_FOLDERS", 2)
    index.insert_node("n1", ["n0"])
    index = Index.open(spark, path)
    assert len(index.meta["folders"]["assignments"]) == 1 and index.assignments.count() == 8
    assert index.cluster_of("n0") == index.cluster_of("n1") == 0 and index.cluster_drift(0) == ClusterDrift(0, 2)
    assert index.query_similar("0000", 9).ids[:4] == ["0001", "0002", "n0", "n1"]


def test_similar_numbers_wanted_clusters_only(triangles):
    index, _, _ = triangles
    plan = index.similar(["0000"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
