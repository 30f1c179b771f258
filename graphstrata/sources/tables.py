"""Graphs that the star-schema tables hold. Ids carry their table's name, as keys collide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.sources.frames import FrameSource


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, key: str, kind: str, rank: int, label: str | None = None) -> DataFrame:
    number = F.col(key).cast("long")
    return df.select(
        F.concat(F.lit(f"{kind}:"), number.cast("string")).alias("id"), F.lit(kind).alias("kind"), (F.col(label) if label else F.concat(F.lit(f"{kind}#"), number.cast("string"))).alias("label"),
        (F.lit(rank << 48).cast("long") + number).alias("seq"),
    )


def _edges(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
    ends = [F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (a, b)]
    return df.select(F.concat_ws(">", *ends).alias("id"), ends[0].alias("src"), ends[1].alias("dst"), F.lit(kind).alias("kind"))


def customer_orders(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Stars: each order to its customer."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nodes = _nodes(customers, "c_custkey", "customer", 0, "c_name").unionByName(_nodes(orders, "o_orderkey", "order", 1))
    return FrameSource(nodes, _edges(orders, ("order", "o_orderkey"), ("customer", "o_custkey"), "placed_by"))


def fk_tree(spark: SparkSession, sf_dir: str) -> FrameSource:
    """region - nation - customer and supplier."""
    r, n, c, s = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    nodes = _nodes(r, "r_regionkey", "region", 0, "r_name").unionByName(_nodes(n, "n_nationkey", "nation", 1, "n_name"))
    nodes = nodes.unionByName(_nodes(c, "c_custkey", "customer", 2, "c_name")).unionByName(_nodes(s, "s_suppkey", "supplier", 3, "s_name"))
    edges = _edges(n, ("nation", "n_nationkey"), ("region", "n_regionkey"), "in").unionByName(_edges(c, ("customer", "c_custkey"), ("nation", "c_nationkey"), "in"))
    return FrameSource(nodes, edges.unionByName(_edges(s, ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "in")))


def user_events(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Users and event types, an edge for each event."""
    events = table(spark, sf_dir, "events")
    users = _nodes(events.select("user_id").distinct(), "user_id", "user", 0)
    types = events.select("event_type").distinct().select(F.concat(F.lit("type:"), "event_type").alias("id"), F.lit("type").alias("kind"), F.col("event_type").alias("label"), (F.lit(1 << 48).cast("long") + F.crc32("event_type")).alias("seq"))
    return FrameSource(users.unionByName(types), _edges(events, ("user", "user_id"), ("type", "event_type"), "did"))


def supplier_parts(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Suppliers and parts, an edge for each line item."""
    nodes = _nodes(table(spark, sf_dir, "supplier"), "s_suppkey", "supplier", 0, "s_name").unionByName(_nodes(table(spark, sf_dir, "part"), "p_partkey", "part", 1))
    return FrameSource(nodes, _edges(table(spark, sf_dir, "lineitem"), ("supplier", "l_suppkey"), ("part", "l_partkey"), "supplied"))


def conversation_chain(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Turns, each linked to the next of its conversation."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), t.cast("string"))
    nodes = turns.select(name(F.col("turn")).alias("id"), F.lit("turn").alias("kind"), F.lit(None).cast("string").alias("label"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"))
    links = turns.filter(F.col("turn") > 0)
    return FrameSource(nodes, links.select(name(F.col("turn")).alias("id"), name(F.col("turn") - 1).alias("src"), name(F.col("turn")).alias("dst"), F.lit("next").alias("kind")))
