import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphstrata.model import DanglingEdgeError, Edge, Node, is_v7, new_id
from graphstrata.operators import community, quality
from graphstrata.operators.graph import Graph
from graphstrata.operators.indexing import dense_index
from graphstrata.sources.frames import slice_source
from tests.shapes import DIAMOND, TWO_TRIANGLES, graph, labels, partition


def test_diamond_degrees(spark):
    g = graph(spark, DIAMOND)
    assert g.node_count() == 4
    assert g.twice_total_weight() == 8
    assert [g.degree(i) for i in range(4)] == [2, 2, 3, 1]
    assert [r["dst"] for r in g.neighbors(2).collect()] == [0, 1, 3]


def test_loops_count_once_and_parallel_edges_add(spark):
    g = graph(spark, (2, [(0, 0), (0, 1), (0, 1)]))
    assert (g.degree(0), g.degree(1), g.self_loop(0)) == (3, 2, 1)


def test_first_node_of_an_id_wins_and_order_is_first_appearance(spark):
    source = slice_source(spark, [Node("b", "x", "first"), Node("a", "y"), Node("b", "z", "second")], [Edge("e", "a", "b", "k")])
    g = Graph.from_frames(source.nodes(), source.edges())
    assert [tuple(r) for r in g.vertices.orderBy("idx").select("idx", "id", "label").collect()] == [(0, "b", "first"), (1, "a", None)]


def test_dangling_edge_names_the_endpoint(spark):
    source = slice_source(spark, [Node("a", "x")], [Edge("e", "a", "ghost", "k")])
    with pytest.raises(DanglingEdgeError, match="ghost"):
        Graph.from_frames(source.nodes(), source.edges())


def test_fresh_ids_are_version_7():
    assert is_v7(new_id())
    assert not is_v7("not an id")


def test_dense_index_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = dense_index(df, "k").collect()
    assert sorted((r["k"], r["idx"]) for r in rows) == [(i, i) for i in range(1000)]


def test_renumber(spark):
    assert labels(community.renumber(partition(spark, [5, 17, 5, 99, 17]))) == [0, 1, 0, 2, 1]


@pytest.mark.parametrize(("shape", "split", "q"), [((3, [(0, 1), (1, 2), (0, 2)]), [0, 1, 2], -1 / 3), ((3, [(0, 1), (1, 2), (0, 2)]), [0, 0, 0], 0.0), (TWO_TRIANGLES, [0, 0, 0, 1, 1, 1], 0.5)])
def test_modularity(spark, shape, split, q):
    assert community.modularity(graph(spark, shape), partition(spark, split)) == pytest.approx(q)


def test_modularity_wants_equal_sizes(spark):
    with pytest.raises(ValueError):
        community.modularity(graph(spark, TWO_TRIANGLES), partition(spark, [0, 1]))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=25), st.lists(st.integers(0, 2), min_size=7, max_size=7))
def test_coarsening_keeps_modularity(spark, pairs, split):
    g, p = graph(spark, (7, pairs)), partition(spark, split)
    fine = community.modularity_row(g.adj, p).first()[0]
    m2 = sum(1 if a == b else 2 for a, b in pairs)
    inside = sum((1 if a == b else 2) for a, b in pairs if split[a] == split[b])
    degree = [0] * 7
    for a, b in pairs:
        degree[a] += 1
        degree[b] += a != b
    total = {c: sum(d for d, s in zip(degree, split, strict=True) if s == c) for c in set(split)}
    assert fine == pytest.approx(inside / m2 - sum(t * t for t in total.values()) / m2**2)
    upper = community.coarsen(g.adj, p)
    alone = spark.createDataFrame([(c, c) for c in range(3)], "idx long, community int")
    assert community.modularity_row(upper, alone).first()[0] == pytest.approx(fine)


@pytest.mark.parametrize(
    ("a", "b", "value"),
    [("000111222", "000111222", 1), ("001122", "997733", 1), ("0000000000", "0000000000", 1), ("0000000000", "0000011111", 0), ("0011", "0101", 0), ("00001111", "00112233", 2 / 3), ("", "", 1)],
)
def test_nmi(spark, a, b, value):
    p, q = (partition(spark, [int(c) for c in x]) for x in (a, b))
    assert quality.nmi(p, q) == pytest.approx(value, abs=1e-9)


def test_nmi_wants_equal_sizes(spark):
    with pytest.raises(ValueError):
        quality.nmi(partition(spark, [0, 0, 1]), partition(spark, [0, 1]))
