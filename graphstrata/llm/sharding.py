"""Sharding by jump consistent hashing.

A shard is a function of the document's key and the shard count alone: there is no
ring table to keep, and appending a shard moves rows only into the new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphstrata.runtime import materialize

_MULTIPLIER = np.uint64(2862933555777941757)  # fixed value of the published algorithm
_CHUNK = 1 << 20


def jump_hash(keys: np.ndarray, *counts: int) -> list[np.ndarray]:
    """The shard of each 64-bit key, for each of the ascending shard ``counts``."""
    state = keys.astype(np.uint64)
    at = np.full(len(keys), -1, np.int64)
    ahead = np.zeros(len(keys), np.int64)
    out = []
    for count in counts:
        live = np.flatnonzero(ahead < count)
        while live.size:
            at[live] = ahead[live]
            state[live] = state[live] * _MULTIPLIER + np.uint64(1)
            span = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            ahead[live] = ((at[live] + 1) * (float(1 << 31) / span)).astype(np.int64)
            live = live[ahead[live] < count]
        out.append(at.astype(np.int32))
    return out


def _jump(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            now, grown = jump_hash(keys, shards, shards + 1)
            columns = [batch.column(c) for c in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(now), pa.array(grown)], names=["doc_id", "size", "text_crc32", "shard", "grown_shard"])

    return run


def assign_shards(docs: DataFrame, shards: int = 40, buckets: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``key``. A null text has no bytes (size 16, crc 0); a null key is one key
    like any other; repeated rows stay, in neighbouring slots; an empty table gives an
    empty result; columns of ``docs`` besides the two are not read.

    Slots are gapless without a task per shard: equal rows are counted first, each
    shard is cut in ``buckets`` by a hash of the row, slots run inside a bucket, and a
    table of at most shards x buckets offsets (so bounded, and broadcast) is added.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 16).alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"),
    ).withColumn("h", F.xxhash64("doc_id"))
    placed = slim.mapInArrow(_jump(shards), "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    row = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    counted = materialize(
        placed.groupBy(*row).agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy("shard", "bucket").agg(F.sum("copies").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    started = counted.withColumn("local", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"])
    last = F.col("copies") - 1
    chunked = started.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(_CHUNK).cast("long"))))
    each = chunked.withColumn("copy", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + (_CHUNK - 1), last))))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("local") + F.col("copy")).cast("long").alias("slot"), "grown_shard",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` in one of 40 shards; nulls, repeats and empty tables as in ``assign_shards``."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
