"""Snapshots of tables in a folder that many readers and writers share.

A snapshot is a small file that names, for each table, the folders it is read from. It
follows the one that its writer read: the writer puts a note of its name beside that one,
which only the first of several writers can do. Readers go from note to note, and begin
at the newest that CURRENT names, which may lag but never leads astray.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from graphstrata.model import FORMAT_VERSION, ConflictError, CorruptionError, UnsupportedFormatError


class Folder:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str, over: bool) -> None:
        beside = self._at(f".{name.replace('/', '_')}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        chosen = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        chosen[0] = options.OVERWRITE if over else options.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        try:
            context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(self._at(name)), chosen)
        except Py4JJavaError:
            self.fs.delete(beside, False)
            raise

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed over."""
        self._put(name, text, True)

    def claim(self, name: str, text: str) -> bool:
        """The same for a file that isn't there yet; false if someone else's is."""
        try:
            self._put(name, text, False)
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        return True


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @staticmethod
    def _next(name: str | None) -> str:
        return f"{name}/_next" if name else "_next"

    def head(self) -> str | None:
        """The newest snapshot, null if there is none."""
        name = self.folder.read("CURRENT").strip() if self.folder.exists("CURRENT") else None
        while self.folder.exists(self._next(name)):
            name = self.folder.read(self._next(name)).strip()
        return name

    def meta(self, name: str) -> dict:
        try:
            meta = json.loads(self.folder.read(f"{name}/_meta.json"))
            version = meta["format_version"]
        except Exception as e:
            raise CorruptionError(f"the snapshot {name!r} has no readable _meta.json") from e
        if version != FORMAT_VERSION:
            raise UnsupportedFormatError(f"format {version}; this version reads {FORMAT_VERSION}")
        return {**meta, "name": name}

    def table(self, meta: Mapping, table: str, schema: str | None = None) -> DataFrame:
        folders = [f"{self.folder.path}/{f}" for f in meta["folders"].get(table, [])]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*folders)

    def commit(self, tables: Mapping[str, DataFrame], parent: str | None, meta: Mapping, kept: Mapping[str, list[str]] | None = None, clustered: Mapping[str, tuple[str, list[str]]] | None = None) -> str:
        """Write a snapshot after ``parent``, from ``tables`` and the folders ``kept`` from before, which no commit changes. Returns its name.

        ``clustered``: tables to be partitioned by the range of a column and sorted by others.
        An error if another writer's snapshot follows ``parent`` already.
        """
        name = f"snapshots/{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        folders = {table: list(old) for table, old in (kept or {}).items()}

        def write(table: str, df: DataFrame) -> None:
            if clustered and table in clustered:
                by, order = clustered[table]
                df = df.repartitionByRange(by).sortWithinPartitions(*order)
            df.write.parquet(f"{self.folder.path}/{name}/{table}")

        with ThreadPoolExecutor(4) as pool:
            for done in [pool.submit(write, *t) for t in tables.items()]:
                done.result()
        for table in tables:
            folders.setdefault(table, []).append(f"{name}/{table}")
        self.folder.write(f"{name}/_meta.json", json.dumps({**meta, "format_version": FORMAT_VERSION, "folders": folders}))
        if not self.folder.claim(self._next(parent), name):
            raise ConflictError(f"another snapshot follows {parent or 'the beginning'}: read it and try again")
        self.folder.write("CURRENT", name)
        return name
