"""The layered index: built once, kept as Parquet snapshots, asked for many seeds at once."""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphstrata.model import (
    FORMAT_VERSION,
    BuildStats,
    ClusterDrift,
    DriftReport,
    DuplicateNodeError,
    HubKind,
    IndexConfig,
    MaintenancePolicy,
    MaintenanceReport,
)
from graphstrata.operators import community, hubs, paths
from graphstrata.operators.graph import Graph
from graphstrata.operators.indexing import dense_index
from graphstrata.operators.joins import BROADCAST_ROWS, join_lookup, large, small
from graphstrata.operators.placement import place, settle
from graphstrata.plans.store import Store
from graphstrata.runtime import materialize
from graphstrata.sources.frames import GraphSource

TABLES = ("assignments", "clusters", "cluster_edges", "hub_edges")
#: Folders of assignments that inserts may leave before they are written as one.
MOST_FOLDERS = 32


@dataclass(frozen=True)
class QueryStats:
    clusters_visited: int
    hubs_visited: int


@dataclass(frozen=True)
class QueryResult:
    ids: list[str]
    stats: QueryStats


@dataclass(frozen=True)
class LabelledResult:
    labels: list[str]
    stats: QueryStats

    @classmethod
    def empty(cls) -> LabelledResult:
        """What a label that no node has is answered with."""
        return cls([], QueryStats(0, 0))


@dataclass(frozen=True)
class SameCluster:
    start: str


@dataclass(frozen=True)
class Similar:
    start: str
    limit: int


def _hubs(graph: Graph, config: IndexConfig) -> tuple[DataFrame, DataFrame]:
    """The hubs, and the edges of their graph by id, which are put together as they are read."""
    hub_set = hubs.choose(graph, config)
    named = graph.vertices.select("idx", "id").join(hub_set.select("idx").distinct(), "idx", "left_semi")
    met = paths.hub_graph(graph.adj, named, config.k_hop)
    return hub_set, met.select("src_id", "dst_id", F.col("dst").alias("dst_idx"), F.col("w").cast("float").alias("w"))


def _tables(graph: Graph, partition: DataFrame, hub_set: DataFrame, regions: DataFrame) -> dict[str, DataFrame]:
    flags = hub_set.select("idx").distinct().withColumn("hub", F.lit(True))
    placed = graph.vertices.select("idx", "id", "label").join(partition, "idx").join(flags, "idx", "left")
    placed = placed.select("id", "idx", F.col("community").cast("int").alias("cluster"), F.coalesce("hub", F.lit(False)).alias("is_hub"), "label")

    def of_nodes() -> tuple[DataFrame, DataFrame]:
        assignments = materialize(placed.join(regions, "cluster").select("id", "idx", "cluster", "region", "is_hub", "label"))
        clusters = assignments.groupBy("cluster").agg(F.min("region").alias("region"), F.count(F.lit(1)).alias("size"), F.sum(F.col("is_hub").cast("long")).alias("hub_count"))
        return assignments, materialize(clusters.withColumns({"generation": F.lit(0).cast("long"), "delta_inserts": F.lit(0).cast("long")}))

    def of_clusters() -> DataFrame:
        near = community.cluster_adjacency(graph.adj, partition)
        return materialize(near.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("w").cast("float").alias("w")))

    with ThreadPoolExecutor(2) as pool:
        nodes, near = pool.submit(of_nodes), pool.submit(of_clusters)
        assignments, clusters = nodes.result()
        return {"assignments": assignments, "clusters": clusters, "cluster_edges": near.result()}


@contextmanager
def _phase(spark: SparkSession, seconds: dict[str, float], name: str):
    spark.sparkContext.setJobDescription(f"index: {name}")
    began = time.monotonic()
    try:
        yield
    finally:
        seconds[name] = time.monotonic() - began
        spark.sparkContext.setJobDescription(None)


def build(
    source: GraphSource, config: IndexConfig | None = None, partition: DataFrame | None = None, path: str | None = None, spark: SparkSession | None = None
) -> tuple[Index, BuildStats]:
    """Build an index, in memory or, with ``path``, as a new snapshot there.

    ``partition`` (id, community) takes the place of Leiden's communities.
    """
    config = config or IndexConfig()
    nodes, edges = source.nodes(), source.edges()
    spark, seconds = spark or nodes.sparkSession, {}
    with _phase(spark, seconds, "graph"):
        graph = Graph.from_frames(nodes, edges)
    with ThreadPoolExecutor(1) as pool:
        met = pool.submit(_hubs, graph, config)  # beside the communities: neither waits for the other
        with _phase(spark, seconds, "clusters"):
            if partition is None:
                found = large(community.leiden(graph, config.seed))
            else:
                found = large(materialize(community.renumber(graph.vertices.select("idx", "id").join(large(partition), "id").select("idx", "community"))))
        with _phase(spark, seconds, "regions"):
            regions = materialize(community.regions(graph.adj, found, config.seed))
        with _phase(spark, seconds, "hubs"):
            hub_set, hub_edges = met.result()
    with _phase(spark, seconds, "tables"):
        made = {**_tables(graph, found, hub_set, regions), "hub_edges": hub_edges}
    stats = BuildStats(made["assignments"].count(), made["clusters"].count(), regions.select("region").distinct().count(), hub_set.count(), seconds)
    if path is None:
        return Index(spark, made), stats
    with _phase(spark, seconds, "commit"):
        return commit(spark, path, made, config), stats


_ANY = object()


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], config: IndexConfig | dict | None = None, kept: dict[str, list[str]] | None = None, parent: object = _ANY) -> Index:
    """Write a snapshot: readers see the old one or the new one whole.

    A snapshot names the folders that each table is read from: those just written, after
    the ones ``kept`` from snapshots before. ``parent`` is the snapshot that the tables
    were made from, and must still be the newest; without it the new one replaces whatever is there.
    """
    store = Store(spark, path)
    if not isinstance(config, dict):
        config = config or IndexConfig()
        config = {"hub_fraction": config.hub_fraction, "hubs": config.hubs.value, "samples": config.samples, "k_hop": config.k_hop}
    # a cluster's members are read from few files
    store.commit(tables, store.head() if parent is _ANY else parent, {"config": config}, kept, {"assignments": ("cluster", ["cluster", "id"])})
    return Index.open(spark, path)


class Index:
    """assignments(id, idx, cluster, region, is_hub, label), clusters(cluster, region, size, hub_count, generation,
    delta_inserts), cluster_edges(src, dst, w), hub_edges(src_id, dst_id, dst_idx, w)."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], path: str | None = None, meta: dict | None = None):
        self.spark, self.tables, self.path, self.meta = spark, tables, path, meta or {}
        self.assignments, self.clusters, self.cluster_edges, self.hub_edges = (tables[t] for t in TABLES)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        store = Store(spark, path)
        name = store.head()
        if name is None:
            return cls.empty(spark, path)
        meta = store.meta(name)
        meta["folders"] = meta.get("folders") or {t: [f"{name}/{t}"] for t in TABLES}
        return cls(spark, {t: store.table(meta, t) for t in TABLES}, path, meta)

    @classmethod
    def empty(cls, spark: SparkSession, path: str | None = None) -> Index:
        schemas = {
            "assignments": "id string, idx long, cluster int, region int, is_hub boolean, label string",
            "clusters": "cluster int, region int, size long, hub_count long, generation long, delta_inserts long",
            "cluster_edges": "src int, dst int, w float", "hub_edges": "src_id string, dst_id string, dst_idx long, w float",
        }
        return cls(spark, {t: spark.createDataFrame([], s) for t, s in schemas.items()}, path)

    # ------------------------------------------------------------ lookups

    def _one(self, node_id: str):
        return self.assignments.filter(F.col("id") == node_id).first()

    def cluster_of(self, node_id: str) -> int | None:
        row = self._one(node_id)
        return row and row["cluster"]

    def region_of(self, node_id: str) -> int | None:
        row = self._one(node_id)
        return row and row["region"]

    def is_hub(self, node_id: str) -> bool:
        row = self._one(node_id)
        return bool(row and row["is_hub"])

    def label_of(self, node_id: str) -> str | None:
        row = self._one(node_id)
        return row and row["label"]

    @cached_property
    def labels(self) -> DataFrame:
        """(label, id): the last node of each label."""
        return self.assignments.filter(F.col("label").isNotNull()).groupBy("label").agg(F.max_by("id", "idx").alias("id"))

    def id_of_label(self, label: str) -> str | None:
        row = self.labels.filter(F.col("label") == label).first()
        return row and row["id"]

    def cluster_members(self, cluster: int) -> list[str] | None:
        found = [r["id"] for r in self.assignments.filter(F.col("cluster") == cluster).select("id").orderBy("id").collect()]
        return found or None

    def hub_neighbors(self, hub: str) -> list[tuple[str, float]]:
        return [(r["dst_id"], r["w"]) for r in self.hub_edges.filter(F.col("src_id") == hub).orderBy("dst_idx").collect()]

    def cluster_neighbors(self, cluster: int) -> list[tuple[int, float]]:
        return [(r["dst"], r["w"]) for r in self.cluster_edges.filter(F.col("src") == cluster).orderBy("dst").collect()]

    def cluster_meta(self, cluster: int) -> tuple[int, int] | None:
        row = self.clusters.filter(F.col("cluster") == cluster).first()
        return row and (row["size"], row["hub_count"])

    def cluster_drift(self, cluster: int) -> ClusterDrift:
        row = self.clusters.filter(F.col("cluster") == cluster).first()
        return ClusterDrift(row["generation"], row["delta_inserts"]) if row else ClusterDrift(0, 0)

    def stats(self) -> dict[str, int]:
        row = self.clusters.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("hub_count"), F.lit(0)).alias("hubs")).first()
        return row.asDict()

    # ------------------------------------------------------------ queries, for many seeds

    def _seeds(self, seeds: DataFrame | Iterable[str]) -> DataFrame:
        if not isinstance(seeds, DataFrame):
            seeds = self.spark.createDataFrame([(s,) for s in seeds], "seed string")
        return seeds.select("seed").distinct()

    def same_cluster(self, seeds: DataFrame | Iterable[str]) -> DataFrame:
        """(seed, rank, id): all members of each seed's cluster, itself included; unknown seeds have no rows."""
        placed = materialize(self._seeds(seeds).join(self.assignments.select(F.col("id").alias("seed"), "cluster"), "seed"))
        wanted = self.assignments.select("id", "cluster").join(small(placed.select("cluster").distinct()), "cluster", "left_semi")
        # members are numbered once for all of a cluster's seeds, by ranges, so that a cluster of a third of all nodes is spread
        numbered = dense_index(wanted, "cluster", "id", name="place")
        first = numbered.groupBy("cluster").agg(F.min("place").alias("first"))
        ranked = join_lookup(numbered, first, "cluster", "place", "inner").select("cluster", (F.col("place") - F.col("first") + 1).cast("int").alias("rank"), "id")
        return ranked.join(placed, "cluster").select("seed", "rank", "id")

    def _plan(self, seeds: DataFrame | Iterable[str], limit: int) -> tuple[DataFrame, DataFrame]:
        """Hops (seed, hop, cluster, fresh, own) by which clusters come in, own cluster at hop 0, and the seeds' own figures."""
        a = self.assignments
        own = self._seeds(seeds).join(a.select(F.col("id").alias("seed"), F.col("cluster").alias("own"), "is_hub"), "seed")
        first_hub = a.filter("is_hub").groupBy(F.col("cluster").alias("own")).agg(F.min("id").alias("hub"))
        own = own.join(first_hub, "own", "left").join(self.clusters.select(F.col("cluster").alias("own"), F.col("size").alias("own_size")), "own")
        own = own.select("seed", "own", "own_size", F.when(F.col("is_hub"), F.col("seed")).otherwise(F.col("hub")).alias("entry"))
        own = materialize(own)
        wanting = own.filter(F.col("own_size") - 1 < limit)
        target = a.select(F.col("id").alias("dst_id"), "cluster")
        # the order of an entry's hubs doesn't depend on the seed: it is numbered once for each hub that some seed goes on from
        order = Window.partitionBy("src_id").orderBy(F.desc("w"), "dst_idx")
        edges = self.hub_edges.join(small(wanting.select(F.col("entry").alias("src_id")).distinct()), "src_id", "left_semi")
        hops = edges.withColumn("hop", F.row_number().over(order)).join(target, "dst_id").select(F.col("src_id").alias("entry"), "hop", "cluster")
        reached = wanting.join(hops, "entry").select("seed", "own", "own_size", "hop", "cluster")
        return own, reached

    def similar(self, seeds: DataFrame | Iterable[str], limit: int) -> DataFrame:
        """(seed, rank, id): members of the own cluster by id, then of the clusters of the entry hub's neighbours, nearest first."""
        if limit <= 0:
            return self.spark.createDataFrame([], "seed string, rank int, id string")
        own, reached = self._plan(seeds, limit)
        first = reached.filter(F.col("cluster") != F.col("own")).groupBy("seed", "cluster").agg(F.min("hop").alias("hop"))
        sized = first.join(self.clusters.select("cluster", "size"), "cluster").join(own.select("seed", "own_size"), "seed")
        before = F.coalesce(F.sum("size").over(Window.partitionBy("seed").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("own_size") - 1
        needed = sized.withColumn("before", before).filter(F.col("before") < limit).select("seed", "cluster", "before", F.lit(False).alias("home"))
        clusters = own.select("seed", F.col("own").alias("cluster"), F.lit(0).cast("long").alias("before"), F.lit(True).alias("home")).unionByName(needed)
        # of a cluster that is wanted no more than limit + 1 members can be wanted by anyone
        some = Window.partitionBy("cluster").orderBy("id")
        wanted = self.assignments.select("id", "cluster").join(clusters.select("cluster").distinct(), "cluster", "left_semi")
        members = materialize(wanted.withColumn("n", F.row_number().over(some)).filter(F.col("n") <= limit + 1).select("id", "cluster", "n"))
        found = clusters.join(small(members), "cluster").filter(F.col("id") != F.col("seed"))
        # a member's rank follows from its place in its cluster and the sizes before, as the seed only stands in its own
        rank = F.col("before") + F.col("n") - F.when(F.col("home") & (F.col("seed") < F.col("id")), 1).otherwise(0)
        return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= limit).select("seed", "rank", "id")

    def similar_stats(self, seeds: DataFrame | Iterable[str], limit: int) -> DataFrame:
        """(seed, clusters_visited, hubs_visited, distinct_clusters) of ``similar``. Clusters count each time that a hub leads to them, as they are drained anew."""
        if limit <= 0:
            return self.spark.createDataFrame([], "seed string, clusters_visited long, hubs_visited long, distinct_clusters long")
        own, reached = self._plan(seeds, limit)
        other = F.col("cluster") != F.col("own")
        first = F.row_number().over(Window.partitionBy("seed", "cluster").orderBy("hop")) == 1
        counted = reached.withColumns({"other": other.cast("long"), "new": (other & first).cast("long")}).join(self.clusters.select("cluster", "size"), "cluster")
        run = Window.partitionBy("seed").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
        had = F.coalesce(F.sum(F.col("new") * F.col("size")).over(run), F.lit(0)) + F.col("own_size") - 1
        visited = counted.withColumn("had", had).filter(F.col("had") < limit)
        sums = visited.groupBy("seed").agg(F.count(F.lit(1)).alias("h"), F.sum("other").alias("c"), F.sum("new").alias("d"))
        both = own.select("seed").join(sums, "seed", "left").fillna(0, ["h", "c", "d"])
        return both.select("seed", (F.lit(1) + F.col("c")).alias("clusters_visited"), F.col("h").alias("hubs_visited"), (F.lit(1) + F.col("d")).alias("distinct_clusters"))

    def walk(self, seeds: DataFrame | Iterable[str], steps: int, queue: int = 32) -> DataFrame:
        """(seed, step, hub, cost): the hubs that each seed's search visits, nearest first, step 0 being its entry.

        All seeds walk at once. In a step each visits the hub of its queue that is nearest to
        the entry along edges of the hub graph, an edge being as long as its hops, the lower
        id first, and puts that one's neighbours into the queue, of which the ``queue``
        nearest stay. No hub is visited twice; a seed whose queue is empty has come to the
        end. Seeds without an entry hub have no rows.
        """
        own, _ = self._plan(seeds, 1)
        near = self.hub_edges.select(F.col("src_id").alias("hub"), F.col("dst_id").alias("further"), F.round(1.0 / F.col("w")).cast("long").alias("hops"))
        waiting = materialize(own.filter("entry IS NOT NULL").select("seed", F.col("entry").alias("hub"), F.lit(0).cast("long").alias("cost")))
        order = Window.partitionBy("seed").orderBy("cost", "hub")
        visited: list[DataFrame] = []
        for step in range(steps + 1):
            ranked = waiting.withColumn("place", F.row_number().over(order))
            now = materialize(ranked.filter("place = 1").select("seed", "hub", "cost", F.lit(step).alias("step")))
            visited.append(now)
            if step == steps or not now.limit(1).count():
                break
            seen = visited[0]
            for more in visited[1:]:
                seen = seen.unionByName(more)
            offers = now.join(near, "hub").select("seed", F.col("further").alias("hub"), (F.col("cost") + F.col("hops")).alias("cost"))
            kept = ranked.filter("place > 1").select("seed", "hub", "cost").unionByName(offers).groupBy("seed", "hub").agg(F.min("cost").alias("cost"))
            kept = kept.join(seen.select("seed", "hub"), ["seed", "hub"], "left_anti").withColumn("place", F.row_number().over(order))
            waiting = materialize(kept.filter(F.col("place") <= queue).select("seed", "hub", "cost"))
        out = visited[0]
        for more in visited[1:]:
            out = out.unionByName(more)
        return out.select("seed", "step", "hub", "cost")

    def similar_by_walk(self, seeds: DataFrame | Iterable[str], limit: int, steps: int, queue: int = 32) -> DataFrame:
        """(seed, rank, id) as ``similar``, over the hubs of a walk in place of the entry's neighbours alone."""
        own, _ = self._plan(seeds, limit)
        where = self.assignments.select(F.col("id").alias("hub"), "cluster")
        met = self.walk(seeds, steps, queue).join(where, "hub").select("seed", "cluster", (F.col("step") + 1).alias("hop"))
        every = own.select("seed", F.col("own").alias("cluster"), F.lit(0).alias("hop")).unionByName(met).groupBy("seed", "cluster").agg(F.min("hop").alias("hop"))
        wanted = materialize(every)
        some = Window.partitionBy("cluster").orderBy("id")
        members = self.assignments.select("id", "cluster").join(small(wanted.select("cluster").distinct()), "cluster", "left_semi")
        members = members.withColumn("n", F.row_number().over(some)).filter(F.col("n") <= limit + 1).select("id", "cluster")
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("hop", "id"))
        return wanted.join(members, "cluster").filter(F.col("id") != F.col("seed")).withColumn("rank", rank).filter(F.col("rank") <= limit).select("seed", "rank", "id")

    def _named(self, found: DataFrame, seeds: DataFrame) -> DataFrame:
        names = self.assignments.select("id", "label")
        return found.join(names, "id", "left").join(seeds, "seed").select(F.col("seed_label").alias("seed"), "rank", F.coalesce("label", "id").alias("label"))

    def _by_label(self, labels: DataFrame | Iterable[str]) -> DataFrame:
        """(seed_label, seed) of known labels; a DataFrame holds them in its first column."""
        asked = labels.select(F.col(labels.columns[0]).alias("seed_label")) if isinstance(labels, DataFrame) else self.spark.createDataFrame([(x,) for x in labels], "seed_label string")
        asked = asked.distinct()
        return materialize(asked.join(self.labels.select(F.col("label").alias("seed_label"), F.col("id").alias("seed")), "seed_label"))

    def same_cluster_by_label(self, labels: DataFrame | Iterable[str]) -> DataFrame:
        """(seed, rank, label); nodes without a label go by their id."""
        seeds = self._by_label(labels)
        return self._named(self.same_cluster(seeds), seeds)

    def similar_by_label(self, labels: DataFrame | Iterable[str], limit: int) -> DataFrame:
        seeds = self._by_label(labels)
        return self._named(self.similar(seeds, limit), seeds)

    def query_same_cluster(self, start: str) -> QueryResult:
        ids = [r["id"] for r in self.same_cluster([start]).orderBy("rank").collect()]
        return QueryResult(ids, QueryStats(1 if ids else 0, 0))

    def query_similar(self, start: str, limit: int) -> QueryResult:
        ids = [r["id"] for r in self.similar([start], limit).orderBy("rank").collect()]
        row = self.similar_stats([start], limit).first()
        return QueryResult(ids, QueryStats(row["clusters_visited"], row["hubs_visited"]) if row else QueryStats(0, 0))

    def query(self, kind: SameCluster | Similar) -> QueryResult:
        """One question about one node."""
        return self.query_same_cluster(kind.start) if isinstance(kind, SameCluster) else self.query_similar(kind.start, kind.limit)

    def query_by_label(self, kind: SameCluster | Similar) -> LabelledResult:
        """The same with a label for the node, answered with labels; nodes without one go by their id."""
        start = self.id_of_label(kind.start)
        if start is None:
            return LabelledResult.empty()
        found = self.query(SameCluster(start) if isinstance(kind, SameCluster) else Similar(start, kind.limit))
        names = {r["id"]: r["label"] for r in self.assignments.join(self.spark.createDataFrame([(i,) for i in found.ids], "id string"), "id", "left_semi").select("id", "label").collect()}
        return LabelledResult([names.get(i) or i for i in found.ids], found.stats)

    # ------------------------------------------------------------ maintenance

    def next_cluster_id(self) -> int:
        return self.clusters.agg(F.coalesce(F.max("cluster") + 1, F.lit(0))).first()[0]

    def drift_frame(self) -> DataFrame:
        return self.clusters.select("cluster", "generation", "delta_inserts")

    def drift_report(self) -> DriftReport:
        return DriftReport({r["cluster"]: ClusterDrift(r["generation"], r["delta_inserts"]) for r in self.drift_frame().orderBy("cluster").collect()})

    def maintain(self, policy: MaintenancePolicy) -> MaintenanceReport:
        return MaintenanceReport(list(policy.decide(self.drift_report())))

    def _region_of_new(self) -> DataFrame:
        return self.assignments.groupBy("cluster").agg(F.min_by("region", "id").alias("region"))

    def insert(self, new: DataFrame, order_insensitive: bool = False) -> tuple[Index, DataFrame]:
        """Insert (id, seeds array<string>[, seq]) and return the index after it, and (id, cluster).

        A node goes to the cluster that most of its known seeds are in (a seed named twice
        votes twice; the lowest id wins ties), or else to a new one. In order of ``seq``,
        later rows may name earlier ones as seeds, and are placed after them, in waves.
        With ``order_insensitive`` all rows are placed at once, and don't see one another.
        Batches may have any size.
        """
        new = materialize(new if "seq" in new.columns else new.withColumn("seq", F.monotonically_increasing_id()))
        names, taken = new.select("id"), self.assignments.select("id")
        if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            taken = taken.join(F.broadcast(names), "id", "left_semi")
        again = taken.unionByName(names).groupBy("id").count().filter("count > 1").take(1)
        if again:
            raise DuplicateNodeError(f"node {again[0]['id']} is already there")
        if order_insensitive:
            numbered = dense_index(new.select("id", "seeds", "seq"), "seq", "id", name="n")
            votes = numbered.select("n", F.explode("seeds").alias("seed")).join(self.assignments.select(F.col("id").alias("seed"), "cluster"), "seed")
            chosen = settle(numbered.select("id", "n"), votes.select("n", "cluster", F.lit(1).alias("k")), self.next_cluster_id())
        else:
            chosen = place(new, self.assignments.select("id", "cluster"), self.next_cluster_id())
        return self._with_rows(chosen)

    def _with_rows(self, chosen: DataFrame) -> tuple[Index, DataFrame]:
        """``chosen``: (id, n, cluster), n being the place of a row among the new ones."""
        top = self.assignments.agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0]
        # a cluster may take a third of all rows, so they don't meet by its number
        placed = join_lookup(chosen, materialize(self._region_of_new()), "cluster", "n")
        rows = materialize(placed.select(
            "id", (F.lit(top + 1) + F.col("n")).alias("idx"), "cluster", F.coalesce("region", F.lit(0)).alias("region"), F.lit(False).alias("is_hub"), F.lit(None).cast("string").alias("label")
        ))
        added = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("added"), F.min("region").alias("new_region"))
        clusters = self.clusters.join(added, "cluster", "full").select(
            "cluster", F.coalesce("region", "new_region").alias("region"), (F.coalesce("size", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("size"), F.coalesce("hub_count", F.lit(0)).alias("hub_count"),
            F.coalesce("generation", F.lit(0)).alias("generation"), (F.coalesce("delta_inserts", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("delta_inserts"),
        )
        return self._grown(rows, materialize(clusters)), rows.select("id", "cluster")

    def _grown(self, rows: DataFrame, clusters: DataFrame) -> Index:
        """The index with more rows. On disk only these and the clusters are written; the rest is read from where it lies, until there are MOST_FOLDERS of rows, which are then made one."""
        every = self.assignments.unionByName(rows)
        if not self.path:
            return Index(self.spark, {**self.tables, "assignments": every, "clusters": clusters})
        folders = self.meta.get("folders")
        if folders is None or len(folders["assignments"]) >= MOST_FOLDERS:
            return commit(self.spark, self.path, {**self.tables, "assignments": every, "clusters": clusters}, self.meta.get("config"), parent=self.meta.get("name"))
        return commit(self.spark, self.path, {"assignments": rows, "clusters": clusters}, self.meta.get("config"), {t: f for t, f in folders.items() if t != "clusters"}, self.meta.get("name"))

    def insert_node(self, node_id: str, seeds: list[str]) -> tuple[Index, int]:
        row = self.spark.createDataFrame([(node_id, list(seeds), 0)], "id string, seeds array<string>, seq long")
        after, placed = self.insert(row)
        return after, placed.first()["cluster"]


__all__ = ["HubKind", "Index", "IndexConfig", "LabelledResult", "QueryResult", "QueryStats", "SameCluster", "Similar", "build", "commit"]
