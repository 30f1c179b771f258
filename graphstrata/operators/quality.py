"""How alike two partitions are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nmi_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (nmi) for two partitions (idx, community): 2I / (Ha + Hb), 1 if both are trivial or empty, 0 if one is."""
    both = a.select("idx", F.col("community").alias("a")).join(b.select("idx", F.col("community").alias("b")), "idx")
    cells = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))

    def entropy(side: str) -> DataFrame:
        sizes = cells.groupBy(side).agg(F.sum("n").alias("n"))
        # n ln n summed, so that no total is needed before the sums
        return sizes.agg(F.sum(F.col("n") * F.ln("n")).alias(f"s_{side}"), F.sum("n").alias(f"t_{side}"), F.count(F.lit(1)).alias(f"k_{side}"))

    joint = cells.agg(F.sum(F.col("n") * F.ln("n")).alias("s"))
    one = joint.join(entropy("a")).join(entropy("b"))
    n, s = F.col("t_a"), F.col("s")
    h_a, h_b = F.ln(n) - F.col("s_a") / n, F.ln(n) - F.col("s_b") / n
    shared = h_a + h_b - (F.ln(n) - s / n)
    value = F.when(n.isNull() | (F.col("k_a") == 1) & (F.col("k_b") == 1), 1.0).when((F.col("k_a") == 1) | (F.col("k_b") == 1), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * shared / (h_a + h_b))))
    return one.select(value.alias("nmi"))


def nmi(a: DataFrame, b: DataFrame) -> float:
    if a.count() != b.count():
        raise ValueError("the partitions differ in size")
    return float(nmi_row(a, b).first()[0])
