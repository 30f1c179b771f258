"""Betweenness by Brandes' accumulation, exact or from sampled sources.

Nodes with the same neighbours (users of the same event types, leaves of one hub) change
places without changing the graph, so they have one score, and a search from each of them
adds the same to all others. They are made one node of the reduced graph with their number,
and one search stands for all of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphstrata.operators.graph import Graph
from graphstrata.operators.indexing import dense_index
from graphstrata.operators.joins import large
from graphstrata.operators.kernel import Shuffler
from graphstrata.operators.paths import simple
from graphstrata.runtime import materialize

#: Neighbour rows of the reduced graph up to which it is broadcast as arrays (16 bytes a row); above, sources advance by joins.
BROADCAST_ROWS = 2_000_000
#: Samples that are drawn one after another on the driver; more are those of the lowest hashes.
DRAWN = 100_000
_BATCH = 32


def pick_sources(n: int, samples: int, seed: int) -> list[int]:
    """Distinct node numbers in ascending order, by the first swaps of a shuffle; memory grows with the samples only."""
    if samples >= n:
        return list(range(n))
    rng, moved, out = Shuffler(seed), {}, []
    for i in range(samples):
        j = i + rng.next() % (n - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return sorted(out)


def twins(near: DataFrame) -> DataFrame:
    """(idx, rep): the smallest node that has the very same neighbours. Nodes without neighbours have no rows.

    Candidates are told by two hashes of all neighbours, and each is then held against its ``rep`` neighbour by neighbour.
    """
    mark = [F.bit_xor(F.xxhash64("dst", F.lit(salt))).alias(name) for salt, name in ((1, "h"), (2, "g"))]
    each = materialize(near.groupBy(F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("n"), *mark))
    first = each.groupBy("n", "h", "g").agg(F.min("idx").alias("rep"))
    likely = materialize(each.join(first, ["n", "h", "g"]).select("idx", "rep"))
    others = near.join(large(likely).filter("idx != rep").withColumnRenamed("idx", "src"), "src").select(F.col("src").alias("idx"), F.col("rep").alias("src"), "dst")
    apart = materialize(others.join(near, ["src", "dst"], "left_anti").select("idx").distinct())
    return materialize(likely.join(apart.withColumn("apart", F.lit(True)), "idx", "left").select("idx", F.when(F.col("apart"), F.col("idx")).otherwise(F.col("rep")).alias("rep")))


def _accumulate(begin: np.ndarray, dst: np.ndarray, many: np.ndarray, source: int) -> np.ndarray:
    """Dependencies of one source on each one node of a class, a depth at a time. ``many``: nodes of each class; of the source's own all others lie two hops off."""
    n = len(many)
    dist, sigma, stands = np.full(n, -1), np.zeros(n), many.astype(float)
    dist[source], sigma[source], stands[source] = 0, 1.0, 1.0
    front, layers = np.array([source]), []
    while len(front):
        count = begin[front + 1] - begin[front]
        tail = np.repeat(front, count)
        head = dst[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[front], count)]
        dist[head[dist[head] < 0]] = dist[source] + len(layers) + 1
        onward = dist[head] == len(layers) + 1
        tail, head = tail[onward], head[onward]
        np.add.at(sigma, head, sigma[tail] * stands[tail])
        layers.append((tail, head))
        front = np.unique(head)
    delta = np.zeros(n)
    beside = dst[begin[source] : begin[source + 1]]
    if len(beside):
        delta[beside] += (many[source] - 1) / many[beside].sum()
    for tail, head in reversed(layers):
        np.add.at(delta, tail, stands[head] * sigma[tail] / sigma[head] * (1 + delta[head]))
    delta[source] = 0.0
    return delta


def _by_arrays(near: DataFrame, classes: DataFrame) -> DataFrame:
    """(idx, score) of classes (idx, many, times), ``times`` being how often each is a source. Both tables are no longer than BROADCAST_ROWS."""
    spark = near.sparkSession
    known, rows = classes.orderBy("idx").toPandas(), near.toPandas()
    idx, many = known["idx"].to_numpy(), known["many"].to_numpy()
    src, dst = np.searchsorted(idx, rows["src"].to_numpy()), np.searchsorted(idx, rows["dst"].to_numpy())
    order = np.lexsort((dst, src))
    shared = spark.sparkContext.broadcast((np.searchsorted(src[order], np.arange(len(idx) + 1)), dst[order], many, idx))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, dst, many, idx = shared.value
        total = np.zeros(len(many))
        for batch in batches:
            for s, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += times * _accumulate(begin, dst, many, int(np.searchsorted(idx, s)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(idx[some]), pa.array(total[some])], names=["idx", "score"])

    sources = classes.filter("times > 0").select("idx", "times")
    tasks = min(int((known["times"] > 0).sum()), spark.sparkContext.defaultParallelism * 2) or 1
    return sources.repartition(tasks).mapInArrow(run, "idx long, score double")


def _by_joins(near: DataFrame, classes: DataFrame, sources: DataFrame) -> DataFrame:
    """Forward by depth with path counts, then backward, from ``sources`` (source, times), each one node of its class."""
    sizes = classes.select(F.col("idx").alias("node"), "many")
    level = materialize(sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma"), F.lit(1).cast("long").alias("many")))
    levels = [level]
    seen = level.select("source", "node")
    while True:
        step = level.join(near, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum(F.col("sigma") * F.col("many")).alias("sigma"))
        level = materialize(step.join(seen, ["source", "node"], "left_anti").join(sizes, "node").select("source", "node", "sigma", "many"))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "node"))
    below, done = level.withColumn("delta", F.lit(0.0)), []  # nobody
    own = sources.select("source").join(sizes.withColumnsRenamed({"node": "source", "many": "all"}), "source")
    for depth in range(len(levels) - 1, -1, -1):
        up = levels[depth].select("source", F.col("node").alias("v"), F.col("sigma").alias("s_v"))
        gains = up.join(near, F.col("v") == F.col("src")).join(below.withColumnRenamed("source", "_s"), (F.col("source") == F.col("_s")) & (F.col("dst") == F.col("node")))
        added = gains.groupBy("source", F.col("v").alias("node")).agg(F.sum(F.col("many") * F.col("s_v") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
        below = levels[depth].join(added, ["source", "node"], "left").fillna(0.0, ["delta"])
        if depth == 1:  # what the others of the source's class pass on their way to it
            ways = levels[1].groupBy("source").agg(F.sum("many").alias("ways"))
            below = below.join(own, "source").join(ways, "source").withColumn("delta", F.col("delta") + (F.col("all") - 1) / F.col("ways")).drop("all", "ways")
        below = materialize(below.select("source", "node", "sigma", "many", "delta"))
        done.append(below)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return materialize(out.filter(F.col("source") != F.col("node")).join(sources, "source").groupBy(F.col("node").alias("idx")).agg(F.sum(F.col("delta") * F.col("times")).alias("score")))


def _chosen(vertices: DataFrame, n: int, samples: int, seed: int) -> DataFrame:
    """(idx) of the sources: every node, some drawn on the driver, or where these are many, the nodes of the lowest hashes."""
    if samples >= n:
        return vertices.select("idx")
    if samples <= DRAWN:
        return vertices.sparkSession.createDataFrame([(s,) for s in pick_sources(n, samples, seed)], "idx long")
    return dense_index(vertices.select("idx", F.xxhash64("idx", F.lit(seed)).alias("h")), "h", "idx", name="place").filter(F.col("place") < samples).select("idx")


def betweenness(graph: Graph, samples: int | None = None, seed: int = 42, use_arrays: bool = True) -> DataFrame:
    """(idx, score) over ordered pairs, not halved; every node has a row. Each node is a source, or ``samples`` of them are, and scores are times n/samples then."""
    n = graph.node_count()
    samples = n if samples is None else min(samples, n)
    if samples <= 0:
        return graph.vertices.select("idx", F.lit(0.0).alias("score"))
    near = materialize(simple(graph.adj))
    same = twins(near)
    chosen = _chosen(graph.vertices, n, samples, seed).withColumn("asked", F.lit(1).cast("long"))
    counted = same.join(chosen, "idx", "left").groupBy(F.col("rep").alias("idx")).agg(F.count(F.lit(1)).alias("many"), F.sum(F.coalesce("asked", F.lit(0).cast("long"))).alias("times"))
    classes = materialize(counted)
    reps = classes.select("idx")
    reduced = materialize(near.join(reps.withColumnRenamed("idx", "src"), "src", "left_semi").join(reps.withColumnRenamed("idx", "dst"), "dst", "left_semi").select("src", "dst"))
    if use_arrays and reduced.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        scores = _by_arrays(reduced, classes)
    else:
        order = dense_index(classes.filter("times > 0").select(F.col("idx").alias("source"), "times"), "source", name="place")
        parts = [_by_joins(reduced, classes, order.filter(F.floor(F.col("place") / _BATCH) == i).select("source", "times")) for i in range(-(-order.count() // _BATCH))]
        scores = parts[0] if parts else classes.select("idx", F.lit(0.0).alias("score")).limit(0)
        for p in parts[1:]:
            scores = scores.unionByName(p)
    total = scores.groupBy(F.col("idx").alias("rep")).agg((F.sum("score") * F.lit(n / samples)).alias("score"))
    return materialize(graph.vertices.select("idx").join(same, "idx", "left").join(total, "rep", "left").select("idx", F.coalesce("score", F.lit(0.0)).alias("score")))
