"""Hub sets: tables (idx)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphstrata.model import HubKind, IndexConfig
from graphstrata.operators.centrality import betweenness
from graphstrata.operators.graph import Graph
from graphstrata.operators.indexing import dense_index
from graphstrata.runtime import materialize


def _size(n: int, fraction: float) -> int:
    """In binary floating point, as a share of 0.07 of 100 is a little over 7."""
    f = 0.0 if math.isnan(fraction) else min(1.0, max(0.0, fraction))
    return math.ceil(n * f)


def _top(scores: DataFrame, k: int) -> DataFrame:
    """The k rows (idx, score) of the largest score, smallest idx first on ties. k may be a share of all nodes: rows are numbered, and none passes through one task."""
    return dense_index(scores.select("idx", (-F.col("score")).alias("down")), "down", "idx", name="place").filter(F.col("place") < k).select("idx")


def from_top_fraction(graph: Graph, fraction: float) -> DataFrame:
    return _top(graph.vertices.select("idx", F.col("degree").alias("score")), _size(graph.node_count(), fraction))


def from_degree_threshold(graph: Graph, least: float) -> DataFrame:
    return graph.vertices.filter(F.col("degree") >= least).select("idx")


def from_centrality(graph: Graph, samples: int | None, fraction: float, seed: int = 42) -> DataFrame:
    return _top(betweenness(graph, samples, seed), _size(graph.node_count(), fraction))


def from_kinds(graph: Graph, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Hubs by node kind; ``nodes`` has (id, kind)."""
    return graph.vertices.join(nodes.filter(F.col("kind").isin(kinds)).select("id"), "id", "left_semi").select("idx")


def from_indices(graph: Graph, indices: list[int]) -> DataFrame:
    return graph.adj.sparkSession.createDataFrame([(i,) for i in sorted(set(indices))], "idx long")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("idx").unionByName(b.select("idx")).distinct()


def contains(hubs: DataFrame, idx: int) -> bool:
    return hubs.filter(F.col("idx") == idx).limit(1).count() > 0


def choose(graph: Graph, config: IndexConfig) -> DataFrame:
    by_degree = config.hubs in (HubKind.DEGREE, HubKind.DEGREE_AND_BETWEENNESS)
    by_paths = config.hubs in (HubKind.BETWEENNESS, HubKind.DEGREE_AND_BETWEENNESS)
    found = [from_top_fraction(graph, config.hub_fraction)] if by_degree else []
    if by_paths:
        found.append(from_centrality(graph, config.samples, config.hub_fraction, config.sample_seed))
    return materialize(found[0] if len(found) == 1 else union(*found))
