"""How much of a table goes to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_MOST = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session does: thousands of long texts or arrays would fill an executor."""
    if spark.conf.get(_BYTES, None) in (None, str((1 << 63) - 1), str((1 << 31) - 1), "-1"):
        spark.conf.set(_BYTES, str(_MOST))
