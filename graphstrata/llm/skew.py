"""Joins whose plan depends on a counted size, never on a hope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BROADCAST_ROWS = 100_000
_SALTS = 32


def join_counted(left: DataFrame, right: DataFrame, on: str, spread: str, how: str = "left", limit: int = _BROADCAST_ROWS) -> DataFrame:
    """Join to a table with one narrow row for each key.

    ``right`` is counted: up to ``limit`` rows it is broadcast; above, both sides are
    shuffled with the key salted by a hash of ``spread``, so that a key of a third of
    the left rows lies in many tasks.
    """
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")
