"""Planted graphs end to end: relevance of answers, and corridors that keep distances."""

import pytest
from pyspark.sql import functions as F

from graphstrata.model import HubKind, IndexConfig
from graphstrata.operators import community, paths
from graphstrata.plans.index import Index, build
from graphstrata.sources.frames import pair_source
from tests.shapes import Xorshift, blocks, graph


def precision(frame, k):
    """Share of answers in the seed's planted block."""
    same = F.col("id").cast("int") % k == F.col("seed").cast("int") % k
    return frame.agg(F.avg(same.cast("double"))).first()[0]


def test_answers_stay_in_the_planted_block(spark):
    index, _ = build(pair_source(spark, *blocks(400, 8, 0.40, 0.01, 0xC0FFEEC0FFEE)), IndexConfig(hubs=HubKind.DEGREE))
    seeds = [f"{i:04d}" for i in range(0, 400, 40)]
    assert precision(index.similar(seeds, 20), 8) >= 0.85
    assert precision(index.same_cluster(seeds), 8) >= 0.95


def test_answers_survive_a_reopen(spark, tmp_path):
    path = str(tmp_path / "index")
    build(pair_source(spark, *blocks(200, 5, 0.30, 0.02, 0x12345678)), IndexConfig(hubs=HubKind.DEGREE), path=path)
    assert precision(Index.open(spark, path).similar([f"{i:04d}" for i in range(0, 200, 20)], 20), 5) >= 0.70


@pytest.mark.parametrize(("n", "k", "p", "q", "most"), [(400, 8, 0.40, 0.01, 0.55), (300, 6, 0.25, 0.025, 0.75)])
def test_corridors(spark, n, k, p, q, most):
    g = graph(spark, blocks(n, k, p, q, 0xC0FFEE))
    part = community.leiden(g)
    label = {r["idx"]: r["community"] for r in part.collect()}
    rng, pairs = Xorshift(0xFEEDBEEF), []
    while len(pairs) < 60:
        a, b = rng.next() % n, rng.next() % n
        if label[a] != label[b]:
            pairs.append((a, b))
    found = paths.cluster_corridors(community.cluster_adjacency(g.adj, part), part.selectExpr("community cluster").distinct(), [(label[a], label[b]) for a, b in pairs])
    asked = spark.createDataFrame([(a, b, found[label[a], label[b]]) for a, b in pairs], "src long, dst long, clusters array<int>")
    rows = paths.evaluate_corridors(g.adj, part, asked).collect()
    assert all(r["corridor_dist"] is not None for r in rows)
    assert sum(r["corridor_dist"] == r["global_dist"] for r in rows) >= 0.80 * len(rows)
    assert sum(r["member_count"] for r in rows) / len(rows) / n < most
