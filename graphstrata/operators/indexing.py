"""Dense numbers for rows without passing them all through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphstrata.runtime import materialize

_LOW = 33  # bits of the row number inside a partition in monotonically_increasing_id


def dense_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """``df`` with numbers from 0 in the given order.

    Rows are range-partitioned and numbered inside their partition; the partitions'
    offsets, as many as there are partitions, are broadcast and added.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOW)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["_part"], total))
        total += row["n"]
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at")
    lookup = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(lookup), "_part")
    return numbered.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << _LOW) - 1))).drop("_at", "_part", "_offset")
