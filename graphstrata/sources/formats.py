"""``spark.read.format("gml")`` and ``format("sqldump")``: what the files tell, a row for each fact.

A partition reads one file. With the option ``cuts``, which ``gml_blocks.cuts`` makes, a
long GML file is read by many, each of the nodes and edges that begin in its block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphstrata.sources import gml_blocks, gml_text, sqldump_text

BLOCK_BYTES = 64 << 20
_BATCH = 65_536
_TEXT, _LONG, _INT = pa.string(), pa.int64(), pa.int32()
GML_COLUMNS = [("file", _TEXT), ("fact", _TEXT), ("a", _TEXT), ("b", _TEXT), ("seq", _LONG), ("error", _TEXT), ("line", _INT), ("part", pa.bool_())]
DUMP_COLUMNS = [("file", _TEXT), ("line", _INT), ("fact", _TEXT), ("a", _TEXT), ("b", _TEXT), ("routine_id", _INT)]


def batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def _batches(rows: Iterable[tuple], columns: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield batch(held, columns)
            held = []
    yield batch(held, columns)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"file:/", path) or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[str]:
    """The file at a path, or all below it whose names don't begin with a dot or an underscore."""
    system, inside = opened(path)
    if system.get_file_info(inside).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inside, recursive=True))
    shown = [f.path for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._]", f.path[len(inside) :])]
    return sorted(path[: len(path) - len(inside)] + f if path.endswith(inside) else f for f in shown)


def _whole_text(path: str) -> str:
    system, inside = opened(path)
    with system.open_input_stream(inside) as f:
        return f.read().decode("utf-8", "replace")


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Nothing(InputPartition):
    """What an empty folder is read as."""


@dataclass
class Block(InputPartition):
    cut: dict


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        cuts = json.loads(self.options.get("cuts") or "[]")
        long = {opened(c["file"])[1] for c in cuts}
        return [File(f) for f in files(self.options["path"]) if opened(f)[1] not in long] + [Block(c) for c in cuts] or [Nothing()]


class _GmlReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Nothing):
            return _batches([], GML_COLUMNS)
        if isinstance(partition, Block):
            return _batches((r + (True,) for r in gml_blocks.read(partition.cut)), GML_COLUMNS)
        return _batches((r + (False,) for r in gml_text.rows(partition.path, _whole_text(partition.path))), GML_COLUMNS)


class _DumpReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Nothing):
            return _batches([], DUMP_COLUMNS)
        return _batches(((partition.path, *fact) for fact in sqldump_text.facts(_whole_text(partition.path))), DUMP_COLUMNS)


class GmlDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gml"

    def schema(self) -> str:
        return "file string, fact string, a string, b string, seq long, error string, line int, part boolean"

    def reader(self, schema) -> DataSourceReader:
        return _GmlReader(dict(self.options))


class DumpDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> str:
        return "file string, line int, fact string, a string, b string, routine_id int"

    def reader(self, schema) -> DataSourceReader:
        return _DumpReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(GmlDataSource)
    spark.dataSource.register(DumpDataSource)
