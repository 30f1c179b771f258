"""Columns for node identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7() -> Column:
    """A fresh version-7 UUID in each row. It is random: materialise the table before using it twice."""
    stamp = F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0")
    tail = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    return F.lower(
        F.concat(
            F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(tail, 14, 3),
            F.lit("-"), F.substring(tail, 17, 4), F.lit("-"), F.substring(tail, 21, 12),
        )
    )


def is_uuid7(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce((F.length(col) == 36) & (F.substring(col, 15, 1) == "7"), F.lit(False))


def id_bytes(col: Column | str) -> Column:
    return F.unhex(F.replace(F.col(col) if isinstance(col, str) else col, F.lit("-"), F.lit("")))
