"""Edge lists: a pair of unsigned numbers a line, ``#`` comments, blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.model import EdgeListParseError
from graphstrata.sources.frames import FrameSource

_PAIR = r"^\s*\+?([0-9]+)\s+\+?([0-9]+)\s*$"
_NUMBER = "decimal(20,0)"  # of unsigned 64 bits
_TOO_LARGE = str(1 << 64)


def _source(lines: DataFrame) -> FrameSource:
    told = lines.filter(~F.col("value").rlike(r"^\s*(#|$)"))
    pairs = told.select(F.regexp_extract("value", _PAIR, 1).cast(_NUMBER).alias("a"), F.regexp_extract("value", _PAIR, 2).cast(_NUMBER).alias("b"))
    edges = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    name = F.col("n").cast("string")
    key = F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
    return FrameSource(
        nodes.select(name.alias("id"), F.lit("node").alias("kind"), name.alias("label"), F.col("n").alias("seq")),
        edges.select(key.alias("id"), F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.lit("edge").alias("kind"), F.struct("a", "b").alias("seq")),
    )


def _bad(lines: DataFrame) -> DataFrame:
    a, b = (F.regexp_extract("value", _PAIR, i).try_cast("decimal(38,0)") for i in (1, 2))
    bound = F.lit(_TOO_LARGE).cast("decimal(38,0)")
    fits = F.coalesce((a < bound) & (b < bound), F.lit(False))
    return lines.filter(~F.col("value").rlike(r"^\s*(#|$)") & ~(F.col("value").rlike(_PAIR) & fits))


def from_path(spark: SparkSession, path: str, validate: bool = True) -> FrameSource:
    """Edges as unordered pairs, each once; nodes in the order of their numbers, which are their labels.

    A bad line is an error that names its number; the lines are numbered only then,
    from the one file that holds it.
    """
    lines = spark.read.text(path)
    if validate:
        wrong = _bad(lines.select("value", F.col("_metadata.file_path").alias("file"))).take(1)
        if wrong:
            whole = spark.read.text(wrong[0]["file"], wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
            first = _bad(whole).orderBy("line").first()
            raise EdgeListParseError(f"expected two numbers, found {first['value']!r}", first["line"] + 1)
    return _source(lines)


def from_text(spark: SparkSession, text: str) -> FrameSource:
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(text.splitlines())], "line long, value string")
    first = _bad(lines).orderBy("line").first()
    if first:
        raise EdgeListParseError(f"expected two numbers, found {first['value']!r}", first["line"] + 1)
    return _source(lines.select("value"))
