"""The undirected weighted graph that every analysis reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphstrata.model import DanglingEdgeError
from graphstrata.operators.indexing import dense_index
from graphstrata.operators.joins import large
from graphstrata.runtime import discard, materialize


def with_seq(df: DataFrame) -> DataFrame:
    return df if "seq" in df.columns else materialize(df.withColumn("seq", F.monotonically_increasing_id()))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id, the first by seq."""
    rest = [c for c in ("kind", "label") if c in nodes.columns]
    return nodes.groupBy("id").agg(F.min("seq").alias("seq"), *(F.min_by(c, "seq").alias(c) for c in rest))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of endpoints that no node has."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.join(nodes.select("id"), "id", "left_anti").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions with parallel edges summed; a loop counts once. Weight 1 where there is none."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    both = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(F.explode(both).alias("e"), w.alias("w")).groupBy("e.src", "e.dst").agg(F.sum("w").alias("w"))


@dataclass(frozen=True)
class Graph:
    """vertices(idx, id, label, degree, loop_w) and adj(src, dst, w), symmetric."""

    vertices: DataFrame
    adj: DataFrame

    @classmethod
    def from_frames(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """Numbers nodes by first appearance; a dangling edge is an error that names the endpoint."""
        nodes = first_nodes(with_seq(nodes))
        if "label" not in nodes.columns:
            nodes = nodes.withColumn("label", F.lit(None).cast("string"))
        numbered = dense_index(nodes.select("seq", "id", "label"), "seq", "id").drop("seq")
        index = numbered.select("idx", "id")
        src, dst = (index.withColumnsRenamed({"id": f"_{e}", "idx": f"{e}_idx"}) for e in ("s", "d"))
        pairs = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), *(["w"] if "w" in edges.columns else [])).join(src, "_s", "left").join(dst, "_d", "left")
        indexed = materialize(pairs.select(F.col("s_idx").alias("src"), F.col("d_idx").alias("dst"), *(["w"] if "w" in edges.columns else [])))
        if indexed.filter(F.col("src").isNull() | F.col("dst").isNull()).limit(1).count():
            raise DanglingEdgeError(dangling(numbered, edges).first()["id"])
        adj = materialize(symmetric(indexed))
        discard(indexed)
        return cls.from_adjacency(numbered, adj)

    @classmethod
    def from_adjacency(cls, numbered: DataFrame, adj: DataFrame) -> Graph:
        """``numbered``: idx, id, label."""
        sums = large(adj).groupBy(F.col("src").alias("idx")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop_w"))
        joined = numbered.join(sums, "idx", "left").fillna(0.0, ["degree", "loop_w"])
        return cls(materialize(joined.select("idx", "id", "label", "degree", "loop_w")), adj)

    def node_count(self) -> int:
        return self.vertices.count()

    def twice_total_weight(self) -> float:
        return float(self.vertices.agg(F.sum("degree")).first()[0] or 0.0)

    def index_of(self, node_id: str) -> int | None:
        row = self.vertices.filter(F.col("id") == node_id).select("idx").first()
        return row and row["idx"]

    def node_id(self, idx: int) -> str | None:
        row = self.vertices.filter(F.col("idx") == idx).select("id").first()
        return row and row["id"]

    def degree(self, idx: int) -> float:
        row = self.vertices.filter(F.col("idx") == idx).select("degree").first()
        return row["degree"] if row else 0.0

    def self_loop(self, idx: int) -> float:
        row = self.vertices.filter(F.col("idx") == idx).select("loop_w").first()
        return row["loop_w"] if row else 0.0

    def neighbors(self, idx: int) -> DataFrame:
        return self.adj.filter(F.col("src") == idx).select("dst", "w").orderBy("dst")
