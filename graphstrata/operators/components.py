"""Connected components by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphstrata.runtime import materialize

_MOST_ROUNDS = 60


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def _union_find(table: pa.Table) -> pa.Table:
    nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    half = table.num_rows
    for a, b in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pa.table({"node": pa.array(nodes), "component": pa.array(nodes[[root(i) for i in range(len(nodes))]])})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task_rows: int = 0) -> DataFrame:
    """(node, component) for every endpoint of ``edges``; the component is its smallest node.

    Each round hangs every larger neighbour of a node under the smallest of its
    neighbourhood, then does the same with the smaller ones. The rounds are
    logarithmic in the longest path, the edge table never grows, and each round's
    table is written to the shared folder, so a lost executor costs one round. Up to
    ``one_task_rows`` edges, counted first, go to one task instead.
    """
    if one_task_rows and edges.limit(one_task_rows + 1).count() <= one_task_rows:
        plain = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
        return materialize(plain.groupBy(F.lit(0).alias("one")).applyInArrow(_union_find, "node long, component long"))
    nodes = materialize(edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node"))).distinct())
    now = materialize(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter(F.col("a") != F.col("b")).distinct())
    for _ in range(_MOST_ROUNDS):
        if not now.limit(1).count():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _min_neighbour(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        low = _min_neighbour(large)
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after = materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter(F.col("a") != F.col("b")).distinct())
        same = after.count() == now.count() and not after.join(now, ["a", "b"], "left_anti").limit(1).count()
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {_MOST_ROUNDS} rounds")
    return nodes.join(now.withColumnsRenamed({"a": "node", "b": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
