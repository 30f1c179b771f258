"""What a graph can be read from."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from graphstrata.model import EDGE_SCHEMA, NODE_SCHEMA, Edge, Node


class GraphSource(Protocol):
    def nodes(self) -> DataFrame: ...  # id, kind, label, seq

    def edges(self) -> DataFrame: ...  # id, src, dst, kind, seq


@dataclass(frozen=True)
class FrameSource:
    """Two DataFrames; columns beyond id, src and dst are optional."""

    nodes_df: DataFrame
    edges_df: DataFrame

    def nodes(self) -> DataFrame:
        return self.nodes_df

    def edges(self) -> DataFrame:
        return self.edges_df

    def node_count(self) -> int:
        return self.nodes_df.count()

    def edge_count(self) -> int:
        return self.edges_df.count()


def slice_source(spark: SparkSession, nodes: Iterable[Node], edges: Iterable[Edge]) -> FrameSource:
    """From rows in memory, unvalidated; their order is the order of appearance."""
    return FrameSource(
        spark.createDataFrame([(n.id, n.kind, n.label, i) for i, n in enumerate(nodes)], NODE_SCHEMA),
        spark.createDataFrame([(e.id, e.src, e.dst, e.kind, i) for i, e in enumerate(edges)], EDGE_SCHEMA),
    )


def pair_source(spark: SparkSession, n: int, pairs: Iterable[tuple[int, int]], kind: str = "node") -> FrameSource:
    """Nodes node_0 to node_{n-1}, and edges by number. Ids are padded so that their order is that of the numbers."""
    width = max(4, len(str(n)))
    name = [f"{i:0{width}d}" for i in range(n)]
    return slice_source(spark, [Node(name[i], kind, f"node_{i}") for i in range(n)], [Edge(f"e{k}", name[a], name[b], "edge") for k, (a, b) in enumerate(pairs)])
