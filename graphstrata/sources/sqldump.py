"""Schemas from SQL dumps: tables as nodes, foreign keys and tables used by one routine as edges.

A dump is read line by line by a small state machine that writes facts; what follows
from the facts is joined and counted as tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.runtime import materialize
from graphstrata.sources import formats
from graphstrata.sources.sqldump_text import facts

FACTS = "file string, line int, fact string, a string, b string, routine_id int"

def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(f, *fact) for f, t in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True) for fact in facts(t)]
        yield formats.batch(rows, formats.DUMP_COLUMNS)


def routine_pairs(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(a, b, n), a < b: in how many routines both tables are named. ``mentions``: the columns ``by``, and table."""
    by = by or ["routine_id"]
    once = mentions.select(*by, "table").distinct()
    pairs = once.withColumnRenamed("table", "a").join(once.withColumnRenamed("table", "b"), by).filter(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class SqlDumpSource:
    facts: DataFrame

    def tables(self) -> DataFrame:
        place = F.min(F.struct("file", "line")).alias("seq")
        return self.facts.filter(F.col("fact") == "table").groupBy(F.col("a").alias("name")).agg(place)

    def _declared(self, pairs: DataFrame) -> DataFrame:
        names = self.tables().select("name")
        return pairs.join(names.withColumnRenamed("name", "a"), "a", "left_semi").join(names.withColumnRenamed("name", "b"), "b", "left_semi")

    def foreign_keys(self) -> DataFrame:
        """(a, b, seq); references to tables that the dump doesn't create are dropped."""
        return self._declared(self.facts.filter(F.col("fact") == "fk").select("a", "b", F.struct("file", "line").alias("seq")))

    def dropped_keys(self) -> int:
        return self.facts.filter(F.col("fact") == "fk").count() - self.fk_count()

    def pairs(self) -> DataFrame:
        mentions = self.facts.filter(F.col("fact") == "mention").withColumnRenamed("a", "table")
        return self._declared(routine_pairs(mentions, ["file", "routine_id"]))

    def nodes(self) -> DataFrame:
        return self.tables().select(F.col("name").alias("id"), F.lit("table").alias("kind"), F.col("name").alias("label"), "seq")

    def edges(self) -> DataFrame:
        """Foreign keys, and an edge for each routine that names both tables."""
        at = F.concat_ws(":", "seq.file", F.col("seq.line").cast("string"))
        keys = self.foreign_keys().select(F.concat(F.lit("fk:"), at).alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("fk").alias("kind"))
        each = self.pairs().withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        used = each.select(F.concat_ws(":", F.lit("use"), "a", "b", F.col("k").cast("string")).alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("proc_cooccur").alias("kind"))
        return keys.unionByName(used)

    def table_count(self) -> int:
        return self.tables().count()

    def fk_count(self) -> int:
        return self.foreign_keys().count()

    def proc_pair_count(self) -> int:
        return self.pairs().count()

    def edge_count(self) -> int:
        return self.edges().count()

    def tables_named(self) -> list[str]:
        return [r["name"] for r in self.tables().orderBy("name").collect()]

    def id_of_table(self, name: str) -> str | None:
        row = self.tables().filter(F.col("name") == name).first()
        return row and row["name"]


def from_text(spark: SparkSession, text: str) -> SqlDumpSource:
    docs = spark.createDataFrame([("", text)], "file string, value string")
    return SqlDumpSource(materialize(docs.mapInArrow(_read, FACTS)))


def from_path(spark: SparkSession, path: str) -> SqlDumpSource:
    """All dumps under a path, each read in its own task."""
    formats.register(spark)
    return SqlDumpSource(materialize(spark.read.format("sqldump").load(path)))
