"""Joins to tables whose size decides the plan, and is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows that are broadcast at most: some 10 MB.
BROADCAST_ROWS = 100_000
_SALTS = 32


def _sorted(df: DataFrame) -> DataFrame:
    """Numbers take a tenth of their memory and less in files, by whose bytes Spark broadcasts a table through the driver: what has too many rows is merged."""
    return df.hint("shuffle_merge")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``limit`` rows, and else not to be. It is read twice."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else _sorted(df)


def large(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, not to be broadcast, nor what is joined to it, if it has more than ``limit`` rows. With fewer Spark chooses. For tables that are joined to ones like them; it is read twice."""
    return _sorted(df) if df.limit(limit + 1).count() > limit else df


def join_lookup(left: DataFrame, right: DataFrame, on: str, spread: str, how: str = "left") -> DataFrame:
    """Join to a table with one narrow row for each key: broadcast when small, else salted by a hash of ``spread``, as one key may be of a third of the left rows."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return salted.join(_sorted(copies), [on, "_salt"], how).drop("_salt")
