"""Clusters for nodes that arrive in an order, by the votes of those before them.

A node goes to the cluster that most of its seeds are in, the lowest on ties; seeds may be
nodes that arrived before it. Nodes whose seeds have all been placed are placed together,
a wave at a time. A node that only follows one other, whatever that one's cluster, is set
aside with a pointer to it, and pointers are doubled, so a chain of any length takes a
logarithmic number of rounds. What is left for waves is the depth of the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphstrata.operators.indexing import dense_index
from graphstrata.operators.joins import large, small
from graphstrata.runtime import materialize

#: Names of seeds that are broadcast at most: some 50 MB. Above, all votes are shuffled by the names and sorted.
NAMES = 500_000
_CLUSTERS = 1 << 32


def _empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def _roots(pointers: DataFrame) -> DataFrame:
    """(n, to) with every pointer followed to its end; pointers lead to smaller numbers, so there are ends."""
    now = materialize(pointers)
    while True:
        ahead = now.select(F.col("n").alias("to"), F.col("to").alias("further"))
        joined = materialize(now.join(ahead, "to", "left").select("n", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("jumped")))
        now = joined.select("n", "to")
        if _empty(joined.filter("jumped")):
            return now


def winners(votes: DataFrame) -> DataFrame:
    """(n, cluster) of the most ``votes`` (n, cluster, k), the lowest cluster on ties. They are shuffled once.

    Clusters are ints, so that a count and a cluster make one long, whose maximum is hashed; that of a struct is sorted.
    """
    counted = votes.repartition("n").groupBy("n", "cluster").agg(F.sum("k").cast("long").alias("k"))
    best = counted.groupBy("n").agg(F.max(F.col("k") * F.lit(_CLUSTERS) - F.col("cluster")).alias("best"))
    return best.select("n", F.pmod(-F.col("best"), F.lit(_CLUSTERS)).cast(votes.schema["cluster"].dataType).alias("cluster"))


def settle(numbered: DataFrame, votes: DataFrame, next_cluster: int) -> DataFrame:
    """(id, n, cluster) of arrivals ``numbered`` (id, n) that wait for none of the others: where their ``votes`` (n, cluster, k) take them, or new clusters in their order."""
    # votes are shuffled by n for their sums and meet the names there; who has none keeps its name
    won = large(numbered).join(winners(votes), "n", "left").select("id", "n", F.col("cluster").cast("int").alias("cluster"))
    won = materialize(won)
    alone = dense_index(won.filter("cluster IS NULL").select("id", "n"), "n", name="place")
    fresh = alone.select("id", "n", (F.lit(next_cluster) + F.col("place")).cast("int").alias("cluster"))
    return won.filter("cluster IS NOT NULL").unionByName(fresh)


def place(new: DataFrame, there: DataFrame, next_cluster: int) -> DataFrame:
    """(id, n, cluster) of arrivals ``new`` (id, seeds array<string>, seq), n being their place from 0 by seq, then id.

    ``there``: (id, cluster) of the nodes placed before. A seed named twice votes twice;
    seeds that are nowhere, that come later or that are the node itself don't vote. Nodes
    without a vote get new clusters, from ``next_cluster`` on in their order.
    """
    numbered = dense_index(new.select("id", "seeds", "seq"), "seq", "id", name="n")
    asked = numbered.select("n", F.explode("seeds").alias("seed"))
    # each name is looked up once, among those there and those arriving, so the votes meet one table, once
    names = materialize(asked.select("seed").distinct())
    nobody, nowhere = F.lit(None).cast("long").alias("m"), F.lit(None).cast("long").alias("cluster")
    either = there.select(F.col("id").alias("seed"), F.col("cluster").cast("long").alias("cluster"), nobody).unionByName(numbered.select(F.col("id").alias("seed"), nowhere, F.col("n").alias("m")))
    known = materialize(either.join(small(names, NAMES), "seed", "left_semi"))
    met = materialize(asked.join(small(known, NAMES), "seed").filter("m IS NULL OR m < n").select("n", "cluster", "m", F.lit(1).cast("long").alias("k")))
    votes, deps = met.filter("m IS NULL").select("n", "cluster", "k"), met.filter("m IS NOT NULL").select("n", "m", "k")
    if _empty(deps):
        return settle(numbered.select("id", "n"), votes, next_cluster)
    deps = materialize(deps.groupBy("n", "m").agg(F.sum("k").alias("k")))
    waiting = materialize(deps.select("n").distinct())
    placed = materialize(winners(votes.join(waiting, "n", "left_anti")))
    votes = materialize(votes.join(waiting, "n", "left_semi").groupBy("n", "cluster").agg(F.sum("k").alias("k")))
    voted = placed.select("n").unionByName(waiting)
    alone = dense_index(numbered.select("n").join(voted, "n", "left_anti"), "n", name="place").select("n", (F.lit(next_cluster) + F.col("place")).alias("cluster"))
    placed = alone.unionByName(placed)
    settled, fresh = placed, placed
    pointers: DataFrame | None = None
    while not _empty(deps):
        # what the last wave decided becomes votes
        told = materialize(deps.join(fresh.select(F.col("n").alias("m"), "cluster"), "m", "left"))
        votes = materialize(votes.unionByName(told.filter("cluster IS NOT NULL").select("n", "cluster", "k")).groupBy("n", "cluster").agg(F.sum("k").alias("k")))
        deps = told.filter("cluster IS NULL").select("n", "m", "k")
        # followers of one node that has no cluster yet, and of nothing else
        single = deps.groupBy("n").agg(F.min("m").alias("to"), F.max("m").alias("other")).filter(F.col("to") == F.col("other")).select("n", "to")
        follow = materialize(single.join(votes.select("n").distinct(), "n", "left_anti"))
        if not _empty(follow):
            ends = _roots(follow)
            pointers = ends if pointers is None else pointers.unionByName(ends)
            kept = deps.join(ends.select("n"), "n", "left_anti").join(ends.select(F.col("n").alias("m"), "to"), "m", "left")
            deps = kept.groupBy("n", F.coalesce("to", "m").alias("m")).agg(F.sum("k").alias("k"))
        deps = materialize(deps)
        ready = votes.join(settled.select("n"), "n", "left_anti").join(deps.select("n").distinct(), "n", "left_anti")
        fresh = materialize(winners(ready))
        settled = settled.unionByName(fresh)
    if pointers is not None:
        followed = _roots(pointers).join(settled.withColumnRenamed("n", "to"), "to").select("n", "cluster")
        settled = settled.unionByName(followed)
    return materialize(numbered.select("id", "n").join(settled.select("n", F.col("cluster").cast("int").alias("cluster")), "n"))
