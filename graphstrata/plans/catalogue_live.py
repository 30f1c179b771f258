"""Queries on graphs that change, and of patterns and paths in graphs, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphstrata.operators import paths, patterns
from graphstrata.operators.graph import Graph
from graphstrata.operators.patterns import Hop
from graphstrata.plans.index import Index
from graphstrata.plans.live import LiveGraph, Threshold
from graphstrata.runtime import materialize, shared_dir
from graphstrata.sources import tables
from graphstrata.streaming.counts import counts_now, stream_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/live/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- edges come and go

#: Quantities supplied, an edge for each part, supplier and flag. Returned goods come, accepted ones go, suppliers in debt leave, and small parts are accepted once more.
SUPPLIED = """
every AS (SELECT 'part:' || l_partkey AS p, 'supplier:' || l_suppkey AS s, l_returnflag AS flag, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
left_over AS (SELECT 'supplier:' || s_suppkey AS s FROM supplier WHERE s_acctbal >= 0), tiny AS (SELECT 'part:' || p_partkey AS p FROM part WHERE p_size < 10),
edges AS (SELECT p, s, w FROM every WHERE flag <> 'A' AND s IN (FROM left_over) UNION ALL SELECT p, s, w FROM every WHERE flag = 'A' AND s IN (FROM left_over) AND p IN (FROM tiny)),
nodes AS (SELECT 'part:' || p_partkey AS id, CAST(100 + p_size AS INT) AS cluster FROM part UNION ALL SELECT 'supplier:' || s_suppkey, CAST(s_nationkey AS INT) FROM supplier WHERE s_acctbal >= 0),
adj AS (SELECT src, dst, sum(w) AS w, count(*) AS n FROM (SELECT p AS src, s AS dst, w FROM edges UNION ALL SELECT s, p, w FROM edges) GROUP BY 1, 2)
"""


def _supplied(spark: SparkSession, d: str) -> LiveGraph:
    line, part, supplier = (tables.table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    p, s = F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("supplier:"), "l_suppkey")
    every = line.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("w"))
    every = materialize(every.select(F.concat_ws("/", p, s, "l_returnflag").alias("id"), p.alias("src"), s.alias("dst"), "w", F.col("l_returnflag").alias("flag")))
    source = tables.supplier_parts(spark, d)
    where = part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), (F.col("p_size") + 100).alias("cluster")).union(supplier.select(F.concat(F.lit("supplier:"), "s_suppkey"), "s_nationkey"))
    live = LiveGraph.create(spark, _path(spark), source.nodes(), every.filter("flag IN ('A', 'N')").drop("flag"), where)
    live = live.change(every.filter("flag = 'R'").drop("flag"), every.filter("flag = 'A'").select("id"))
    owing = supplier.filter("s_acctbal < 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    tiny = part.filter("p_size < 10").select(F.concat(F.lit("part:"), "p_partkey").alias("src"))
    again = every.filter("flag = 'A'").drop("flag").join(tiny, "src", "left_semi").join(owing.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return live.change(again.select("id", "src", "dst", "w"), gone=owing)


def _by_id(live: LiveGraph, rows: DataFrame) -> DataFrame:
    names = live.nodes().select("idx", "id")
    return rows.join(names.withColumnsRenamed({"idx": "src", "id": "_s"}), "src").join(names.withColumnsRenamed({"idx": "dst", "id": "_d"}), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *[c for c in rows.columns if c not in ("src", "dst")])


@query(f"WITH {SUPPLIED} SELECT src, dst, w, n FROM adj")
def edge_changes(spark, d):
    """The adjacency after two changes, base and changes merged as it is read."""
    live = _supplied(spark, d)
    return _by_id(live, live.adjacency()).select("src", "dst", "w", "n")


@query(f"WITH {SUPPLIED} SELECT src, dst, w, n FROM adj")
def edge_changes_compacted(spark, d):
    """The same of a base that has taken all changes in, opened from its path."""
    live = LiveGraph.open(spark, _supplied(spark, d).compact().store.folder.path)
    return _by_id(live, live.table("adj")).select("src", "dst", "w", "n")


@query(f"WITH {SUPPLIED} SELECT id, coalesce(sum(w), 0.0) AS degree, CAST(0 AS DOUBLE) AS loop_w FROM nodes LEFT JOIN adj ON src = id GROUP BY id")
def edge_changes_degrees(spark, d):
    """Degrees from the base's and the sums of the changes."""
    live = _supplied(spark, d)
    return live.degrees().join(live.nodes(), "idx").select("id", "degree", "loop_w")


@query(f"""WITH {SUPPLIED}, sums AS (SELECT a.cluster, sum(CASE WHEN a.cluster = b.cluster THEN w ELSE 0 END) AS inside, sum(w) AS total FROM adj JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY 1),
sizes AS (SELECT cluster, count(*) AS size FROM nodes GROUP BY 1)
SELECT cluster, CAST(coalesce(inside, 0) AS DOUBLE) AS inside, CAST(coalesce(total, 0) AS DOUBLE) AS total, size FROM sizes LEFT JOIN sums USING (cluster)""")
def edge_changes_figures(spark, d):
    """Clusters' inner weight, total degree and size, corrected from the changes alone."""
    return _supplied(spark, d).figures().select("cluster", F.col("inner").alias("inside"), "total", "size")


# ---------------------------------------------------------------- clusters follow

#: Urgent orders go over to the customer that has the next number, the last one's to the first.
MOVED = """
ring AS (SELECT c_custkey AS c, coalesce(lead(c_custkey) OVER (ORDER BY c_custkey), first_value(c_custkey) OVER (ORDER BY c_custkey)) AS further FROM customer),
placed AS (SELECT o_orderkey AS o, CASE WHEN o_orderpriority = '1-URGENT' THEN further ELSE c END AS c FROM orders JOIN ring ON c = o_custkey)
"""


@query(f"WITH {MOVED} SELECT 'order:' || o AS id, 'customer:' || c AS centre FROM placed UNION ALL SELECT 'customer:' || c_custkey, 'customer:' || c_custkey FROM customer")
def recluster_stars(spark, d):
    """Stars of customers after their urgent orders moved, of which only those that changed are clustered anew: each is one community."""
    source = tables.customer_orders(spark, d)
    where = source.edges().select(F.col("src").alias("id"), F.col("dst").alias("centre")).union(source.nodes().filter("kind = 'customer'").select("id", "id"))
    number = source.nodes().filter("kind = 'customer'").select(F.col("id").alias("centre"), F.substring_index("id", ":", -1).cast("int").alias("cluster"))
    live = LiveGraph.create(spark, _path(spark), source.nodes(), source.edges(), where.join(number, "centre").select("id", "cluster"))
    urgent = tables.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    numbered = materialize(tables.table(spark, d, "customer").select("c_custkey"))
    low = numbered.agg(F.min("c_custkey")).first()[0]
    further = numbered.select(F.col("c_custkey").alias("o_custkey")).join(numbered.select((F.col("c_custkey") - 1).alias("o_custkey"), F.col("c_custkey").alias("to")), "o_custkey", "left").select("o_custkey", F.coalesce("to", F.lit(low)).alias("to"))
    order, customer = F.concat(F.lit("order:"), "o_orderkey"), F.concat(F.lit("customer:"), "to")
    gone = urgent.select(F.concat_ws(">", order, F.concat(F.lit("customer:"), "o_custkey")).alias("id"))
    come = urgent.join(further, "o_custkey").select(F.concat_ws(">>", order, customer).alias("id"), order.alias("src"), customer.alias("dst"))
    after, _ = live.change(come, gone).maintain(Threshold(changed=0.0, rebuild_share=2.0))
    named = after.partition().join(after.nodes(), "idx")
    centres = named.filter(F.col("id").startswith("customer:")).groupBy("cluster").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return named.join(centres, "cluster").select("id", "centre")


# ---------------------------------------------------------------- the past

_SEGMENTS = "(SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS k FROM (SELECT DISTINCT c_mktsegment FROM customer))"
#: Customers by nation from 10 on; from 20 on five nations are split by segment; from 30 on the rest of these is one with the next nation; from 40 on customers in debt leave.
PAST = f"""
c AS (SELECT 'customer:' || c_custkey AS id, CAST(c_nationkey AS INT) AS n, CAST(100 + 10 * c_nationkey + k AS INT) AS part, c_acctbal AS b FROM customer JOIN {_SEGMENTS} USING (c_mktsegment)),
turns AS (SELECT id, n AS cluster, 10 AS t FROM c UNION ALL SELECT id, CASE WHEN n < 5 THEN part ELSE n END, 20 FROM c UNION ALL SELECT id, CASE WHEN n < 5 AND part % 10 > 2 THEN 5 WHEN n < 5 THEN part ELSE n END, 30 FROM c),
steps AS (SELECT id, cluster, t FROM (SELECT *, lag(cluster) OVER (PARTITION BY id ORDER BY t) AS was FROM turns) WHERE cluster IS DISTINCT FROM was),
spans AS (SELECT s.id, cluster, t AS valid_from, lead(t) OVER (PARTITION BY s.id ORDER BY t) AS later, b FROM steps s JOIN c USING (id)),
intervals AS (SELECT id, CAST(cluster AS INT) AS cluster, CAST(valid_from AS BIGINT) AS valid_from, CAST(coalesce(later, CASE WHEN b < 0 THEN 40 END) AS BIGINT) AS valid_to FROM spans)
"""


def _past(spark: SparkSession, d: str) -> LiveGraph:
    c = tables.table(spark, d, "customer")
    segments = c.select("c_mktsegment").distinct()
    before = segments.withColumnRenamed("c_mktsegment", "other")
    ranks = F.broadcast(segments.join(before, F.col("other") <= F.col("c_mktsegment")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("k")))  # five segments
    rows = materialize(c.join(ranks, "c_mktsegment").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_nationkey").alias("n"), (100 + 10 * F.col("c_nationkey") + F.col("k")).cast("int").alias("part"), "c_acctbal"))
    edges = tables.table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.concat(F.lit("customer:"), "o_custkey").alias("dst"))
    live = LiveGraph.create(spark, _path(spark), rows.select("id"), edges, rows.select("id", F.col("n").alias("cluster")), at=10)
    early = F.col("n") < 5
    live = live.assign(rows.select("id", F.when(early, F.col("part")).otherwise(F.col("n")).alias("cluster")), at=20)
    live = live.assign(rows.select("id", F.when(early & (F.col("part") % 10 > 2), F.lit(5)).when(early, F.col("part")).otherwise(F.col("n")).alias("cluster")), at=30)
    return live.change(gone=rows.filter("c_acctbal < 0").select("id"), at=40)


@query(f"WITH {PAST} SELECT * FROM intervals")
def assignment_history(spark, d):
    live = _past(spark, d)
    return live.intervals().join(live.table("nodes").select("idx", "id"), "idx").select("id", "cluster", "valid_from", "valid_to")


@query(f"WITH {PAST}, asked AS (SELECT id, CAST(5 + 10 * (ascii(right(id, 1)) % 5) AS BIGINT) AS moment FROM c) SELECT asked.id AS seed, moment, cluster FROM asked JOIN intervals USING (id) WHERE valid_from <= moment AND (valid_to IS NULL OR moment < valid_to)")
def query_as_of(spark, d):
    """Where each customer was at a time of its own."""
    live = _past(spark, d)
    return live.clusters_as_of(_asked(live)).withColumnRenamed("at", "moment")


def _asked(live: LiveGraph) -> DataFrame:
    return live.table("nodes").select(F.col("id").alias("seed"), (5 + 10 * (F.ascii(F.substring("id", -1, 1)) % 5)).cast("long").alias("at"))


@query(f"""WITH {PAST}, asked AS (SELECT id, CAST(5 + 10 * (ascii(right(id, 1)) % 5) AS BIGINT) AS moment FROM c),
placed AS (SELECT asked.id AS seed, moment, cluster FROM asked JOIN intervals USING (id) WHERE valid_from <= moment AND (valid_to IS NULL OR moment < valid_to))
SELECT seed, moment, count(*) AS members, min(id) AS first, max(id) AS last FROM placed JOIN intervals USING (cluster) WHERE valid_from <= moment AND (valid_to IS NULL OR moment < valid_to) GROUP BY ALL""")
def same_cluster_as_of(spark, d):
    """Who shared each customer's cluster then."""
    live = _past(spark, d)
    found = live.same_cluster_figures_as_of(_asked(live), F.count(F.lit(1)).alias("members"), F.min("id").alias("first"), F.max("id").alias("last"))
    return found.select("seed", F.col("at").alias("moment"), "members", "first", "last")


#: Who was in which cluster before and after a turn, of clusters that anyone left.
LINES = f"""{PAST},
pairs AS (SELECT CAST(a.cluster AS INT) AS old, CAST(b.cluster AS INT) AS new, count(*) AS n, CAST(b.t AS BIGINT) AS moment FROM turns a JOIN turns b ON a.id = b.id AND b.t = a.t + 10 GROUP BY ALL),
lines AS (SELECT * FROM pairs WHERE (old, moment) IN (SELECT (old, moment) FROM pairs WHERE old <> new))"""


@query(f"""WITH {LINES} SELECT old, new, n, moment,
CASE WHEN count(*) OVER (PARTITION BY old, moment) > 1 AND count(*) OVER (PARTITION BY new, moment) > 1 THEN 'both' WHEN count(*) OVER (PARTITION BY old, moment) > 1 THEN 'split' WHEN count(*) OVER (PARTITION BY new, moment) > 1 THEN 'merge' ELSE 'move' END AS kind FROM lines""")
def cluster_lineage(spark, d):
    return _past(spark, d).lineage().withColumnRenamed("at", "moment")


@query(f"""WITH RECURSIVE {LINES}, shares AS (SELECT old, new, moment AS t, n / sum(n) OVER (PARTITION BY old, moment) AS part FROM lines),
asked AS (SELECT DISTINCT CAST(cluster AS INT) AS cluster, CAST(t AS BIGINT) AS moment FROM turns),
walk AS (SELECT cluster, moment, cluster AS now, moment AS since, CAST(1 AS DOUBLE) AS share FROM asked
  UNION ALL SELECT walk.cluster, walk.moment, new, t, share * part FROM walk JOIN shares ON old = now AND t = (SELECT min(s.t) FROM shares s WHERE s.old = now AND s.t > since))
SELECT cluster, moment, now, round(sum(share), 9) AS share FROM walk w WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.old = w.now AND s.t > w.since) GROUP BY ALL""")
def cluster_heirs(spark, d):
    """What every cluster that ever was has become, by its heirs' heirs."""
    live = _past(spark, d)
    asked = live.intervals().select("cluster", F.col("valid_from").alias("since"), F.coalesce(F.col("valid_to") - 1, F.lit(39)).alias("until"))
    every = asked.select("cluster", F.explode(F.expr("filter(array(10L, 20L, 30L), t -> t >= since AND t <= until)")).alias("at"))
    return live.resolve(every).select("cluster", F.col("at").alias("moment"), "now", F.round("share", 9).alias("share"))


# ---------------------------------------------------------------- patterns and paths


_LOCAL = """SELECT DISTINCT c_custkey AS customer, s_suppkey AS supplier, c_nationkey AS nation
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"""


def _trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of customers, suppliers and nations: who bought of whom, and who is where."""
    customer, orders, line, supplier, nation = (tables.table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nodes = customer.select(named("customer", "c_custkey").alias("id"), F.lit("customer").alias("kind"))
    nodes = nodes.union(supplier.select(named("supplier", "s_suppkey"), F.lit("supplier"))).union(nation.select(named("nation", "n_nationkey"), F.lit("nation")))
    bought = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct().select(named("customer", "o_custkey").alias("src"), named("supplier", "l_suppkey").alias("dst"), F.lit("bought").alias("kind"))
    return nodes, bought.union(customer.select(named("customer", "c_custkey"), named("nation", "c_nationkey"), F.lit("in"))).union(supplier.select(named("supplier", "s_suppkey"), named("nation", "s_nationkey"), F.lit("in")))


def _numbers(found: DataFrame) -> DataFrame:
    return found.select(*(F.substring_index(c, ":", -1).cast(kind).alias(c) for c, kind in (("customer", "long"), ("supplier", "long"), ("nation", "int"))))


@query(_LOCAL)
def pattern_local_supply(spark, d):
    """Customers, suppliers that supplied them, and the nation of both: a triangle of three kinds of edges."""
    pattern = [Hop("customer", "supplier", "bought"), Hop("customer", "nation", "in"), Hop("supplier", "nation", "in")]
    return _numbers(patterns.match(*_trade(spark, d), pattern, {"customer": "customer", "supplier": "supplier", "nation": "nation"}))


@query(_LOCAL)
def pattern_triangles(spark, d):
    """The same of the graph without kinds: all of its triangles."""
    nodes, edges = _trade(spark, d)
    g = Graph.from_frames(nodes, edges)
    ids = g.vertices.select("idx", "id")
    found = materialize(patterns.triangles(g.adj).withColumn("t", F.monotonically_increasing_id()))
    named = found.select("t", F.explode(F.array("a", "b", "c")).alias("idx")).join(ids, "idx").groupBy("t")
    return _numbers(named.agg(*(F.max(F.when(F.col("id").startswith(f"{kind}:"), F.col("id"))).alias(kind) for kind in ("customer", "supplier", "nation"))))


def _by_part(spark: SparkSession, d: str) -> Graph:
    source = tables.supplier_parts(spark, d)
    return Graph.from_frames(source.nodes(), source.edges())


@query("""WITH e AS (SELECT DISTINCT 'part:' || l_partkey AS p, 'supplier:' || l_suppkey AS s FROM lineitem),
pairs AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM e x JOIN e y USING (p) WHERE x.s < y.s GROUP BY 1, 2)
SELECT CAST(coalesce(sum(k * (k - 1) // 2), 0) AS BIGINT) AS squares, CAST(0 AS BIGINT) AS triangles FROM pairs""")
def pattern_squares(spark, d):
    """Two parts and two suppliers that supply both: how many, and no triangles, as parts meet suppliers only."""
    g = _by_part(spark, d)
    n = patterns.squares_by_corner(g.adj).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("squares"))
    return n.withColumn("triangles", F.lit(patterns.triangles(g.adj).count()).cast("long"))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS i FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT x.k AS a, y.k AS b, x.n AS m, y.n AS n, x.r AS r FROM c x JOIN c y ON x.r = y.r AND y.i = x.i + 1)
SELECT a, b, CAST(step AS INT) AS step, id FROM (
  SELECT a, b, 0 AS step, 'customer:' || a AS id FROM p UNION ALL SELECT a, b, 1, 'nation:' || m FROM p UNION ALL SELECT a, b, 2, 'region:' || r FROM p WHERE m <> n
  UNION ALL SELECT a, b, 3, 'nation:' || n FROM p WHERE m <> n UNION ALL SELECT a, b, CASE WHEN m = n THEN 2 ELSE 4 END, 'customer:' || b FROM p)""")
def connect_customers(spark, d):
    """The path between each customer and the next of its region, searched from both ends."""
    source = tables.fk_tree(spark, d)
    g = Graph.from_frames(source.nodes(), source.edges())
    names, asked = g.vertices.select("idx", "id"), _next_customers(spark, d, g)
    found = paths.connect(g.adj, asked.select("src", "dst"), names.select("idx"))
    return found.join(asked, ["src", "dst"]).join(names, found["node"] == names["idx"]).select("a", "b", "step", "id")


def _next_customers(spark: SparkSession, d: str, g: Graph) -> DataFrame:
    """(a, b, src, dst): each customer and the next of its region, by number and by idx."""
    c = tables.table(spark, d, "customer").join(tables.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_regionkey")
    further = Window.partitionBy("n_regionkey").orderBy("c_custkey")
    pairs = c.withColumn("b", F.lead("c_custkey").over(further)).filter("b IS NOT NULL").select(F.col("c_custkey").alias("a"), "b")
    names = g.vertices.select("idx", "id")
    customers = names.filter(F.col("id").startswith("customer:")).select("idx", F.substring_index("id", ":", -1).cast("long").alias("k"))
    return materialize(pairs.join(customers.withColumnsRenamed({"idx": "src", "k": "a"}), "a").join(customers.withColumnsRenamed({"idx": "dst", "k": "b"}), "b"))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS i FROM customer JOIN nation ON n_nationkey = c_nationkey),
size AS (SELECT n_nationkey AS n, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS m FROM nation)
SELECT x.k AS a, y.k AS b, CAST(CASE WHEN x.n = y.n THEN 1 ELSE 3 END AS INT) AS parts, CAST(CASE WHEN x.n = y.n THEN s.m ELSE s.m + t.m + 1 END AS BIGINT) AS members, CAST(CASE WHEN x.n = y.n THEN 2 ELSE 4 END AS INT) AS dist, true AS exact
FROM c x JOIN c y ON x.r = y.r AND y.i = x.i + 1 JOIN size s ON s.n = x.n JOIN size t ON t.n = y.n""")
def route_customers(spark, d):
    """Customers by way of their nations and region: nodes of three communities at most are searched."""
    source = tables.fk_tree(spark, d)
    g = Graph.from_frames(source.nodes(), source.edges())
    asked = _next_customers(spark, d, g)
    place = F.split("id", ":")
    c, s = (tables.table(spark, d, t) for t in ("customer", "supplier"))
    nations = c.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_nationkey").alias("n")).union(s.select(F.concat(F.lit("supplier:"), "s_suppkey"), "s_nationkey"))
    own = F.when(F.col("id").startswith("region:"), 1000 + place[1].cast("long")).when(F.col("id").startswith("nation:"), place[1].cast("long")).otherwise(F.col("n"))
    part = materialize(g.vertices.select("idx", "id").join(nations, "id", "left").select("idx", own.cast("long").alias("community")))
    found = paths.route(g.adj, part, asked.select("src", "dst")).join(asked, ["src", "dst"])
    return found.select("a", "b", F.size("parts").alias("parts"), F.col("member_count").alias("members"), F.col("routed_dist").alias("dist"), F.col("routed_dist").eqNullSafe(F.col("global_dist")).alias("exact"))


#: A graph of hubs, regions and nations, that each walk from itself on.
_WALK = """
hubs AS (SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation),
near AS (SELECT 'nation:' || n_nationkey AS hub, 'region:' || n_regionkey AS further, 1 AS hops FROM nation UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 1 FROM nation),
q0 AS (SELECT id AS seed, id AS hub, 0 AS cost FROM hubs)"""


def _walk_sql(steps: int, queue: int) -> str:
    out, seen = _WALK, []
    for k in range(steps + 1):
        out += f", p{k} AS (SELECT seed, hub, cost, {k} AS step FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cost, hub) AS r FROM q{k}) WHERE r = 1)"
        seen.append(f"SELECT seed, hub FROM p{k}")
        visited = " UNION ALL ".join(seen)
        out += f""", q{k + 1} AS (SELECT seed, hub, cost FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cost, hub) AS r FROM (
  SELECT seed, hub, min(cost) AS cost FROM (SELECT * FROM q{k} UNION ALL SELECT seed, further, cost + hops FROM p{k} JOIN near USING (hub)) WHERE (seed, hub) NOT IN ({visited}) GROUP BY 1, 2)) WHERE r <= {queue})"""
    ends = " UNION ALL ".join(f"SELECT seed, step, hub, cost FROM p{k}" for k in range(steps + 1))
    return f"WITH {out} SELECT seed, CAST(step AS INT) AS step, hub, CAST(cost AS BIGINT) AS cost FROM ({ends})"


@query(_walk_sql(4, 6))
def greedy_walk(spark, d):
    """From each region and nation over four more hubs, six waiting at most: to the second hop and beyond."""
    source = tables.fk_tree(spark, d)
    g = Graph.from_frames(source.nodes(), source.edges())
    names = g.vertices.select("idx", "id")
    hub_set = materialize(names.filter(F.col("id").startswith("region:") | F.col("id").startswith("nation:")))
    met = paths.hub_graph(g.adj, hub_set.select("idx"), 1)
    edges = met.join(names.withColumnsRenamed({"idx": "src", "id": "src_id"}), "src").join(names.withColumnsRenamed({"idx": "dst", "id": "dst_id"}), "dst")
    assignments = names.join(hub_set.select("idx", F.lit(True).alias("h")), "idx", "left").select("id", "idx", F.lit(0).alias("cluster"), F.lit(0).alias("region"), F.coalesce("h", F.lit(False)).alias("is_hub"), F.lit(None).cast("string").alias("label"))
    clusters = assignments.groupBy("cluster", "region").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("is_hub").cast("long")).alias("hub_count")).withColumns({"generation": F.lit(0).cast("long"), "delta_inserts": F.lit(0).cast("long")})
    index = Index(spark, {"assignments": materialize(assignments), "clusters": clusters, "cluster_edges": spark.createDataFrame([], "src int, dst int, w float"), "hub_edges": materialize(edges.select("src_id", "dst_id", F.col("dst").alias("dst_idx"), F.col("w").cast("float").alias("w")))})
    return index.walk(hub_set.select(F.col("id").alias("seed")), 4, 6)


# ---------------------------------------------------------------- state of a stream


@query("SELECT CAST(c_nationkey AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS inserts, CAST(sum(o_orderkey % 5) AS BIGINT) AS votes, CAST(min(o_orderkey) AS BIGINT) AS first_seq, CAST(max(o_orderkey) AS BIGINT) AS last_seq FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def streamed_counts(spark, d):
    """Orders arrive in their customers' nations, those on a Monday once more, by a stream that stops midway and goes on from its checkpoint."""
    orders, customer = tables.table(spark, d, "orders"), tables.table(spark, d, "customer")
    placed = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.col("c_nationkey").cast("long").alias("cluster"), (F.col("o_orderkey") % 5).cast("long").alias("votes"), F.col("o_orderkey").cast("long").alias("seq"), F.weekday(F.to_date("o_orderdate")).alias("day")
    )
    folder, out, state = _path(spark), _path(spark), _path(spark)
    for part in (F.col("day") < 4, (F.col("day") >= 4) | (F.col("day") == 0)):
        placed.filter(part).drop("day").write.mode("append").parquet(folder)
        rows = spark.readStream.schema("id string, cluster long, votes long, seq long").parquet(folder)
        stream_counts(spark, rows, out, state).awaitTermination()
    return counts_now(spark, out)
