"""Where intermediate tables live, and how lineage is cut.

Everything here goes to the shared folder named by ``spark.checkpoint.dir``:
executors may be lost, and whatever they kept on their own disks goes with them.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_UNSET = "/tmp/checkpoints"
#: Bytes of a row group: what a task holds of a table that it writes.
_ROW_GROUP = 32 << 20
_recording: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. One of our own where none is set, in local mode only: a cluster's machines share no such folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{_UNSET}/{spark.sparkContext.applicationId}"
        os.makedirs(found, exist_ok=True)
    return found.rstrip("/")


def materialize(df: DataFrame, *partition_by: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage but its files, so a lost executor costs a re-read
    and no plan above it is computed twice. ``large_rows``: rows of megabytes, of which
    a writer holds one row group's bytes and not a hundred rows, and a reader few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    for paths in _recording:
        paths.append(path)
    writer = df.write.mode("error").option("compression", "zstd").option("parquet.block.size", _ROW_GROUP)
    if large_rows:
        writer = writer.option("parquet.block.size", _ROW_GROUP // 2).option("parquet.page.size.row.check.min", 1)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables that are written meanwhile, for whoever knows when nothing reads them any more."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording[:] = [p for p in _recording if p is not paths]


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned and that nothing reads any more."""
    delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def drop_tables(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote for this session's shared folder."""
    delete(spark, [f"{shared_dir(spark)}/tables"])
