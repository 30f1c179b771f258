"""Ranked lexical search: postings by document shard, scored a term at a time.

The index is a table with a row for each shard, a few megabytes of documents with their
postings as compressed sparse rows: terms, where each one's postings begin, and for each
posting the document's place in the shard and its impact, the integer that a term's
weight is multiplied with. Impacts need the corpus's length alone, which a first pass
counts. Weights need the documents that hold a term, which are added up over the shards
when a query asks. A search adds impacts into one dense array for each item and shard,
keeps the best of each task as it goes, and merges tasks by a ranked window.

Items go to every shard in blocks of bounded size, so any number of them can be asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches
from graphstrata.operators.indexing import dense_index
from graphstrata.runtime import materialize

#: UTF-8 bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Rows (item, term) that are sent to the shards at once. An item is never split.
BLOCK_TERMS = 1 << 17
#: Fixed values of the ranking.
LENGTH_SHARE, SCALE, TF_SCALE, M_SCALE, WEIGHT_SCALE = 75, 1_000_000_000, 1000, 8, 1000

_SHARD = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("begins", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32()))])

_BYTE = np.arange(256)
_IN_TERM = (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def terms_of(raw: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All terms of UTF-8 texts in order, and the text that each is of.

    What separates terms is ASCII, and no byte of a longer code point is: bytes decide.
    """
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _IN_TERM[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(r) + 1 for r in raw])
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    packed = _LOWER[data[inside]]
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]), np.searchsorted(ends, begin, "right")


def _texts(column: pa.Array) -> Iterator[bytes]:
    yield from (x.as_py() or b"" for x in column.cast(pa.binary()))


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms, and all their terms."""
    docs = terms = 0
    for batch in batches:
        for raw in _texts(batch.column("text")):
            inside = _IN_TERM[np.frombuffer(raw, np.uint8)].view(np.int8)
            n = int(np.count_nonzero(np.diff(inside, prepend=np.int8(0)) == 1))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})


def impacts(tf: np.ndarray, length: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term's weight is multiplied with, for term frequencies and documents' lengths."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * docs // terms
    return SCALE * tf // (TF_SCALE * tf + M_SCALE * m)


def shard_row(doc_ids: list[int | None], raw: list[bytes], docs: int, terms: int) -> pa.RecordBatch:
    """The postings of some documents, terms in the order of their bytes."""
    found, place = terms_of(raw)
    coded = found.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key, tf = np.unique(rank[coded.indices.to_numpy()] * len(raw) + place, return_counts=True)
    term, at = np.divmod(key, len(raw)) if len(raw) else (key, key)
    value = impacts(tf.astype(np.int64), np.bincount(place, minlength=len(raw))[at], docs, max(1, terms))
    begins = np.searchsorted(term, np.arange(len(order) + 1))
    whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)
    columns = [whole(doc_ids, pa.int64()), whole(coded.dictionary.take(pa.array(order)), None), whole(begins.astype(np.int32), pa.int32()), whole(at.astype(np.int32), pa.int32()), whole(value.astype(np.int32), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, schema=_SHARD)


def _shards(docs: int, terms: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        raw: list[bytes] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch.column("text")), strict=True):
                if raw and size + len(text) > most:
                    yield shard_row(ids, raw, docs, terms)
                    ids, raw, size = [], [], 0
                ids.append(doc_id)
                raw.append(text)
                size += len(text) + 1
        if raw:
            yield shard_row(ids, raw, docs, terms)

    return run


@dataclass(frozen=True)
class SearchIndex:
    """shards: a table of _SHARD's columns; docs, terms: of the whole corpus, documents without terms left out."""

    shards: DataFrame
    docs: int
    terms: int


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> SearchIndex:
    """Every row of (doc_id, text) is indexed, in shards that no document is split over.

    Null and empty texts have no terms and are never found; a text of any length is read
    whole; rows that share an id are documents each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, length = rows.select("text").mapInArrow(_lengths, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    shards = rows.mapInArrow(_shards(n or 0, length or 0, shard_bytes), "doc_ids array<long>, terms array<binary>, begins array<int>, places array<int>, impacts array<int>")
    return SearchIndex(materialize(shards, large_rows=True), n or 0, length or 0)


# ---------------------------------------------------------------- items


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column("item").to_numpy()
        found, place = terms_of(list(_texts(batch.column("text"))))
        yield pa.RecordBatch.from_pydict({"item": pa.array(items[place], pa.int64()), "term": found})


def _asked(items: DataFrame) -> DataFrame:
    """(item, term, times, block): items' terms, numbered by item, in blocks of BLOCK_TERMS rows or one item."""
    every = items.select("item", "text").mapInArrow(_item_terms, "item long, term binary")
    counted = dense_index(every.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")), "item", "term", name="row")
    first = counted.groupBy("item").agg(F.expr(f"min(row) div {BLOCK_TERMS}").alias("block"))
    return materialize(counted.drop("row").join(first, "item"))


def _held(column: pa.Array) -> pa.Array:
    return column[0].values


def _places_of(wanted: pa.Array, terms: pa.Array) -> np.ndarray:
    """Where in a shard's terms each wanted one is, -1 where it isn't."""
    return pc.fill_null(pc.index_in(wanted, value_set=terms), -1).to_numpy(zero_copy_only=False)


def _one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _holding(block):
    """(n, df): documents of this task that hold the block's n-th term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = block.value[0]
        df = np.zeros(len(wanted), np.int64)
        for shard in _one_by_one(batches):
            at = _places_of(wanted, _held(shard.column("terms")))
            begins = _held(shard.column("begins")).to_numpy()
            hit = at >= 0
            df[hit] += begins[at[hit] + 1] - begins[at[hit]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"n": pa.array(some, pa.int64()), "df": pa.array(df[some])})

    return run


class _Best:
    """The best documents of each item so far, ties to the smaller id; a null id comes last."""

    def __init__(self, items: int, limit: int):
        self.limit = limit
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * items
        self.doc: list[np.ndarray] = [np.zeros(0, np.int64)] * items

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        """Candidates with a score above 0. Those that tie with the last one kept are all looked at before any is left out."""
        if len(self.score[item]) == self.limit:
            score, doc = (x[keep] for keep in [score >= self.score[item][-1]] for x in (score, doc))
        if not len(score):
            return
        if len(score) > self.limit:
            bound = score[np.argpartition(score, -self.limit)[-self.limit]]
            score, doc = (x[keep] for keep in [score >= bound] for x in (score, doc))
        score, doc = np.concatenate([self.score[item], score]), np.concatenate([self.doc[item], doc])
        order = np.lexsort((doc, -score))[: self.limit]
        self.score[item], self.doc[item] = score[order], doc[order]


_NO_ID = np.int64(np.iinfo(np.int64).max)  # stands for a null id while documents are ranked


def _best_of_shards(block, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, items, starts, term_of, factor = block.value
        best = _Best(len(items), limit)
        for shard in _one_by_one(batches):
            ids = _held(shard.column("doc_ids"))
            docs, known = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False), np.arange(len(ids))
            at = _places_of(wanted, _held(shard.column("terms")))
            begins, places, impact = (_held(shard.column(c)).to_numpy() for c in ("begins", "places", "impacts"))
            impact = impact.astype(np.int64)
            total = np.zeros(len(known), np.int64)
            for i in range(len(items)):
                total[:] = 0
                for t, w in zip(at[term_of[starts[i] : starts[i + 1]]].tolist(), factor[starts[i] : starts[i + 1]].tolist(), strict=True):
                    if t >= 0 and w:
                        begin, end = begins[t], begins[t + 1]
                        total[places[begin:end]] += w * impact[begin:end]
                met = np.flatnonzero(total)
                if len(met):
                    best.add(i, total[met], docs[met])
        n = [len(s) for s in best.score]
        doc = np.concatenate([*best.doc, np.zeros(0, np.int64)])
        columns = {"item": pa.array(np.repeat(items, n), pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=doc == _NO_ID), "score": pa.array(np.concatenate([*best.score, np.zeros(0, np.int64)]), pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)

    return run


def weight(docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * docs + 2) / (2 * df + 1)))


def _search_block(index: SearchIndex, asked: DataFrame, limit: int) -> DataFrame:
    """(item, doc_id, score): the best of every task. ``asked`` is one block, so it goes through the driver."""
    context = index.shards.sparkSession.sparkContext
    rows = asked.select("item", "term", "times").orderBy("item", "term").toArrow().combine_chunks()
    coded = rows.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    wanted = coded.dictionary
    names = context.broadcast((wanted,))
    df = np.zeros(len(wanted), np.int64)
    for n, found in index.shards.select("terms", "begins").mapInArrow(_holding(names), "n long, df long").groupBy("n").agg(F.sum("df")).collect():
        df[n] = found
    weights = np.array([weight(index.docs, int(x)) for x in df], np.int64)
    term_of = coded.indices.to_numpy()
    items, starts = np.unique(rows.column("item").to_numpy(), return_index=True)
    factor = weights[term_of] * rows.column("times").to_numpy()
    block = context.broadcast((wanted, items, np.append(starts, len(term_of)), term_of, factor))
    return index.shards.mapInArrow(_best_of_shards(block, limit), "item long, doc_id long, score long")


def search(index: SearchIndex, items: DataFrame, limit: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``limit`` best documents above 0 of each row of (item_id, text).

    Rows that share an item_id are items each. Items without terms, null texts among them,
    have no rows, and so has an empty index. Equal scores go by doc_id, a null id last.
    """
    bounded_batches(items.sparkSession)
    named = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("item")))
    asked = _asked(named)
    blocks = asked.agg(F.max("block")).first()[0]
    found = [_search_block(index, asked.filter(F.col("block") == b), limit) for b in range((-1 if blocks is None else blocks) + 1)]
    if not found:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` against every row of ``documents``."""
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
lengths AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0), corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark), qt AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(terms) AS term FROM q) GROUP BY 1, 2),
s AS (SELECT i, r, CAST(sum(times * CAST(floor({WEIGHT_SCALE} * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
    * (({SCALE} * tf) // ({TF_SCALE} * tf + {M_SCALE} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // total)))) AS BIGINT) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (r), corpus GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s JOIN lengths USING (r) WHERE score > 0) JOIN q USING (i) WHERE rank <= 10
"""
