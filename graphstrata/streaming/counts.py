"""Running figures of clusters, kept as state by cluster while nodes arrive.

An arrival is counted once, by its id, however often it comes and however often a batch is
run again: ids that came are state, the sums are state, both on the checkpoint, and the
files of a batch are taken once. The figures don't depend on the order of arrival; the
order in which things happened is in ``seq``, whose first and last are kept. A cluster's
arrivals are dealt out to several keys, so that one of a third of all rows is not one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

FIGURES = "inserts long, votes long, first_seq long, last_seq long"
_UPDATES = f"cluster long, part int, {FIGURES}"
_PARTS = 16
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sums(StatefulProcessor):
    """Adds a batch's arrivals to a key's figures and tells what they are then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.figures = handle.getValueState("figures", FIGURES)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.figures.get() if self.figures.exists() else None
        inserts, votes, first, last = had or (0, 0, None, None)
        for some in rows:
            inserts, votes = inserts + len(some), votes + int(some["votes"].sum())
            low, high = int(some["seq"].min()), int(some["seq"].max())
            first, last = min(low, low if first is None else first), max(high, high if last is None else last)
        self.figures.update((inserts, votes, first, last))
        yield pd.DataFrame({"cluster": [int(key[0])], "part": [int(key[1])], "inserts": [inserts], "votes": [votes], "first_seq": [first], "last_seq": [last]})

    def close(self) -> None:
        pass


def stream_counts(spark: SparkSession, placed: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the figures of a stream of placed arrivals (id, cluster, votes, seq) in the table at ``path``.

    A batch appends the figures of the keys that it touched. Arrivals without an id or a
    cluster are nobody's and are left out; no votes count as 0.
    """
    whole = placed.filter("id IS NOT NULL AND cluster IS NOT NULL AND seq IS NOT NULL")
    rows = whole.select(F.col("id").cast("string"), F.col("cluster").cast("long"), F.coalesce(F.col("votes"), F.lit(0)).cast("long").alias("votes"), F.col("seq").cast("long"))
    once = rows.dropDuplicates(["id"]).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(_PARTS)).cast("int"))
    told = once.groupBy("cluster", "part").transformWithStateInPandas(_Sums(), _UPDATES, "Append", "None")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        writer = told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def counts_now(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, inserts, votes, first_seq, last_seq) as of the batches that are done."""
    figures = F.struct("inserts", "votes", "first_seq", "last_seq")
    latest = spark.read.schema(_UPDATES).parquet(path).groupBy("cluster", "part").agg(F.max_by(figures, "inserts").alias("now")).select("cluster", "now.*")
    return latest.groupBy("cluster").agg(F.sum("inserts").alias("inserts"), F.sum("votes").alias("votes"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
