"""Line dedup by range-partitioned hashes, answered with keep bitmaps instead of text."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches
from graphstrata.llm.streamed import ROWS, counted_rows, frequent_positions, later_positions, row_batch
from graphstrata.runtime import materialize

_SPACE = b" \t\n\x0b\x0c\r"
_FLUSH = 50_000
#: Bitmaps are broadcast up to so many bytes, which are counted.
_BROADCAST_BYTES = 32 << 20


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(_SPACE).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        keys, docs, rows, copies, places = [], [], [], [], []
        for doc, row, many, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "copies")), batch.column("text"), strict=True):
            at: dict[bytes, list[int]] = {}
            for i, key in enumerate(line_keys(text.as_py())):
                if key:
                    at.setdefault(key, []).append(i)
            keys += map(digest, at)
            docs += [doc] * len(at)
            rows += [row] * len(at)
            copies += [many] * len(at)
            places += at.values()
            if len(keys) >= _FLUSH:
                yield row_batch(keys, docs, rows, copies, places)
                keys, docs, rows, copies, places = [], [], [], [], []
        yield row_batch(keys, docs, rows, copies, places)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for drops in batch.column("drops").to_pylist():
            bits = np.zeros(max(drops) // 8 * 8 + 8, np.uint8)  # whole bytes: what pads the end stays
            bits[drops] = 1
            packed.append(zlib.compress(np.packbits(1 - bits).tobytes(), 1))
        columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int | None = 10) -> DataFrame:
    """doc_id, row_key, keep: for each document that loses lines, a compressed bitmap of those that stay.

    With ``min_docs``, lines found in so many rows lose all their copies; with None,
    each line's first occurrence by document and position stays. A bit is 1 if the line
    stays; lines beyond the bitmap's end stay. A row is a document: rows that repeat an
    id count each, and rows alike in id and text too, but these have one bitmap, and of
    their first occurrences all stay. Lines without a visible character never go. Null
    texts have none; an empty table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = materialize(counted_rows(docs).mapInArrow(_lines, ROWS))
    found = later_positions(rows) if min_docs is None else frequent_positions(rows, min_docs)
    drops = found.groupBy("doc_id", "row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("drops"))
    return drops.mapInArrow(_bitmaps, "doc_id long, row_key long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text that stays, the number of lines and of those dropped."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    stay = np.ones(len(lines), bool)
    stay[: len(bits)] = bits.astype(bool)
    return "\n".join([line for line, s in zip(lines, stay, strict=True) if s]), len(lines), int((~stay).sum())


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows with their bitmaps. These are broadcast while they are counted as few; else Spark sorts and merges, and splits what is skewed."""
    b = materialize(bitmaps.select(F.col("doc_id").alias("_b_doc"), F.col("row_key").alias("_b_row"), F.col("keep").alias("_b_keep")))
    size = b.agg(F.sum(F.octet_length("_b_keep") + 64)).first()[0] or 0
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text).alias("_row_key"))
    both = keyed.join(F.broadcast(b) if size <= _BROADCAST_BYTES else b.hint("merge"), F.col("_doc").eqNullSafe(F.col("_b_doc")) & (F.col("_row_key") == F.col("_b_row")), "left")
    return both.select("_row", "_b_keep")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [kept_lines(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("_b_keep").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([n for _, n, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _, _ in found], pa.string()),
            ],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_summaries(docs: DataFrame, min_docs: int | None = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of ``docs``.

    A null or empty text is one empty line; a null id stays null; repeated rows count and
    are returned each; an empty table gives an empty result; other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = _joined(slim, keep_bitmaps(slim, min_docs)).select("_row.doc_id", "_row.text", "_b_keep")
    return both.mapInArrow(_summaries, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_docs: int | None = 10) -> DataFrame:
    """``docs`` with only the kept lines in text, and n_chars, where there is one, counted anew; other columns as they were.

    Every row stays, also one whose lines all go; null texts stay null; repeated rows are
    treated alike; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def kept(text, keep):
        return text.combine(keep, lambda t, k: kept_lines(t, k)[0])

    both = _joined(docs, keep_bitmaps(docs, min_docs))
    same = F.col("_b_keep").isNull()
    new = {"text": F.when(same, F.col("_row.text")).otherwise(kept("_row.text", "_b_keep"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("_row.n_chars")).otherwise(F.length("text").cast("long"))
    both = both.withColumn("text", new["text"])
    return both.select(*[F.col("text") if c == "text" else new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup at ten documents leaves of ``documents``; nulls, repeats and empty tables as in ``line_summaries``."""
    return line_summaries(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, doc_id, string_split(text, chr(10)) AS parts FROM docs),
line AS (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS dropped FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
