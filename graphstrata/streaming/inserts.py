"""Nodes that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphstrata.plans.index import Index
from graphstrata.runtime import materialize


def stream_inserts(spark: SparkSession, index_path: str, arrivals: DataFrame, checkpoint: str, order_insensitive: bool = False, available_now: bool = True) -> StreamingQuery:
    """Insert a stream of (id, seeds[, seq]) into the index at a path, a snapshot for each micro-batch.

    Without ``seq``, rows are numbered as they come before anything shuffles them. Of rows
    that share an id the first stays. A batch that is run again after a failure finds its
    nodes in place and leaves them out.
    """

    def one(batch: DataFrame, number: int) -> None:
        index = Index.open(spark, index_path)
        numbered = materialize(batch.select("id", "seeds", F.col("seq") if "seq" in batch.columns else F.monotonically_increasing_id().alias("seq")))
        first = numbered.groupBy("id").agg(F.min_by("seeds", "seq").alias("seeds"), F.min("seq").alias("seq"))
        fresh = materialize(first.join(index.assignments.select("id"), "id", "left_anti"))
        if fresh.limit(1).count():
            index.insert(fresh, order_insensitive)

    writer = arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drift_counts(placed: DataFrame) -> DataFrame:
    """A running count of inserts by cluster, for a stream of (id, cluster)."""
    return placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("delta_inserts"))
