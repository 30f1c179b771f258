"""GML files as graphs. A document is parsed as one piece in its own task, a long one in blocks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.model import DanglingEdgeError, GmlParseError
from graphstrata.runtime import materialize
from graphstrata.sources import formats, gml_blocks
from graphstrata.sources.frames import FrameSource
from graphstrata.sources.gml_text import rows

FACTS = "file string, fact string, a string, b string, seq long, error string, line int"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            yield formats.batch(rows(file, text), formats.GML_COLUMNS[:-1])


def _source(facts: DataFrame, node_kind: str, edge_kind: str) -> FrameSource:
    wrong = facts.filter(F.col("fact") == "error").orderBy("file", "seq").select("error", "line").take(1)
    if wrong:
        given = json.loads(wrong[0]["error"])
        if "dangling" in given:
            raise DanglingEdgeError(given["dangling"], wrong[0]["line"])
        error = GmlParseError(given["message"])
        error.line = wrong[0]["line"]
        raise error
    prefix = F.when(F.col("file") == "", F.lit("")).otherwise(F.concat(F.col("file"), F.lit(":")))
    seq = F.struct("file", "seq").alias("seq")
    nodes, edges = (facts.filter(F.col("fact") == f) for f in ("node", "edge"))
    return FrameSource(
        nodes.select(F.concat(prefix, "a").alias("id"), F.lit(node_kind).alias("kind"), F.lit(None).cast("string").alias("label"), seq),
        edges.select(F.concat(prefix, F.col("seq").cast("string")).alias("id"), F.concat(prefix, "a").alias("src"), F.concat(prefix, "b").alias("dst"), F.lit(edge_kind).alias("kind"), seq),
    )


def from_text(spark: SparkSession, text: str, node_kind: str = "node", edge_kind: str = "edge") -> FrameSource:
    docs = spark.createDataFrame([("", text)], "file string, value string")
    return _source(materialize(docs.mapInArrow(_facts, FACTS)), node_kind, edge_kind)


def from_path(spark: SparkSession, path: str, node_kind: str = "node", edge_kind: str = "edge", many: bool = False, block_bytes: int = formats.BLOCK_BYTES) -> FrameSource:
    """One document, or with ``many`` all under a path, whose ids then carry the file's name.

    Documents of more than ``block_bytes`` are read in blocks, each in a task of its own;
    the seq of what is in them is its place in bytes.
    """
    cuts = gml_blocks.cuts(spark, path, block_bytes)
    formats.register(spark)
    read = spark.read.format("gml").option("cuts", json.dumps(cuts)).option("blockBytes", block_bytes).load(path)
    file = F.element_at(F.split(F.col("file"), "/"), -1) if many else F.lit("")
    if not cuts:
        return _source(materialize(read.withColumn("file", file).drop("part")), node_kind, edge_kind)
    return _source(materialize(gml_blocks.named(materialize(read)).withColumn("file", file)), node_kind, edge_kind)
