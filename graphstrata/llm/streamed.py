"""Keys that occur in many documents, found in one sorted stream.

Rows (key, document) are range-partitioned by key, then document, so that a key of a
third of all rows is spread over many tasks in order; each task streams its range and
decides every key that lies wholly inside. Only the first and the last key of a range
may go on elsewhere: of those it reports a count, and the rows it can't yet decide.
That leaves two keys a partition at most, whose totals are broadcast.

Rows of equal id and text, which no key could spread, are counted first and then stand
as one row with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphstrata.runtime import materialize

ROWS = "h1 long, h2 long, doc_id long, row_key long, copies long, positions array<int>"
_OUT = f"kind byte, n long, {ROWS}"
_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("copies", pa.int64()), ("positions", pa.list_(pa.int32()))])
DECIDED, OPEN, COUNT = 0, 1, 2


def row_batch(keys: list[bytes], doc_ids: list, row_keys: list[int], copies: list[int], positions: list[list[int]]) -> pa.RecordBatch:
    """A batch of ROWS from 16-byte keys."""
    halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2) if keys else np.zeros((0, 2), np.int64)
    columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(doc_ids, pa.int64()), pa.array(row_keys, pa.int64()), pa.array(copies, pa.int64()), pa.array(positions, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _mark(batch: pa.RecordBatch, kind: int, n: int = 0) -> pa.RecordBatch:
    ahead = [pa.array(np.full(batch.num_rows, kind, np.int8)), pa.array(np.full(batch.num_rows, n, np.int64))]
    return pa.RecordBatch.from_arrays([*ahead, *batch.columns], names=["kind", "n", *_ARROW.names])


def _without_first_position(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    rest = [p[1:] for p in batch.column(5).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rest, pa.list_(pa.int32()))], schema=_ARROW) if rest and rest[0] else None


class _Run:
    """The key whose rows are still coming."""

    def __init__(self, key: tuple[int, int], first: bool):
        self.key, self.first, self.count, self.held = key, first, 0, []


def _frequent(least: int):
    """All positions of keys that at least ``least`` rows have, copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Run | None = None
        closed = 0

        def close(r: _Run, last: bool) -> Iterator[pa.RecordBatch]:
            if r.first or last:
                yield _mark(_key_row(r.key), COUNT, r.count)
                yield from (_mark(b, OPEN) for b in r.held)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
            count = np.add.reduceat(batch.column(4).to_numpy(), begin)
            edges = {0, len(begin) - 1} | ({1} if len(begin) > 1 and closed == 0 else set())
            inner = np.ones(len(begin), bool)
            inner[list(edges)] = False
            take = np.repeat(inner & (count >= least), end - begin)
            if take.any():
                yield _mark(batch.filter(pa.array(take)), DECIDED)
            for i in sorted(edges):
                lo, hi = int(begin[i]), int(end[i])
                key = (int(h1[lo]), int(h2[lo]))
                if now is None or now.key != key:
                    if now is not None:
                        yield from close(now, False)
                        closed += 1
                    now = _Run(key, closed == 0)
                part = batch.slice(lo, hi - lo)
                now.count += int(count[i])
                if now.count >= least:
                    yield from (_mark(b, DECIDED) for b in (*now.held, part))
                    now.held = []
                else:
                    now.held.append(part)
        if now is not None:
            yield from close(now, True)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All positions but the first of each key, in the order of documents and positions."""
    key, closed = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key != (int(h1[0]), int(h2[0]))
        key = (int(h1[-1]), int(h2[-1]))
        if (~new).any():
            yield _mark(batch.filter(pa.array(~new)), DECIDED)
        firsts = batch.filter(pa.array(new))
        if firsts.num_rows and not closed:
            yield _mark(firsts.slice(0, 1), OPEN)  # the range before may have had this key
            firsts, closed = firsts.slice(1), 1
        many = firsts.filter(pa.array(np.diff(firsts.column(5).offsets.to_numpy()) > 1)) if firsts.num_rows else firsts
        for i in range(many.num_rows):
            yield _mark(_without_first_position(many.slice(i, 1)), DECIDED)
    if key is not None:
        yield _mark(_key_row(key), COUNT, 1)


_PARTNER = "kind byte, h1 long, h2 long, doc_id long, row_key long, positions array<int>, p_doc long, p_row long, p_begins array<int>"
_PARTNER_NAMES = ["kind", "h1", "h2", "doc_id", "row_key", "positions", "p_doc", "p_row", "p_begins"]


def _begins(rows: pa.RecordBatch, partner: pa.RecordBatch) -> pa.ListArray:
    """Where the partner has the key: its first place for a row's first, and so on, its last for what is left."""
    own, theirs = rows.column("positions"), partner.column("positions")
    count, held = (np.diff(x.offsets.to_numpy()) // 2 for x in (own, theirs))
    ends = np.cumsum(count)
    k = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
    at = np.repeat(theirs.offsets.to_numpy()[:-1], count) + 2 * np.minimum(k, np.repeat(held - 1, count))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), theirs.values.take(pa.array(at)))


def _with_partner(rows: pa.RecordBatch, kind: int, partner: pa.RecordBatch) -> pa.RecordBatch:
    """Rows beside the row of another document with the same key."""
    columns = [pa.array(np.full(rows.num_rows, kind, np.int8)), *(rows.column(c) for c in ("h1", "h2", "doc_id", "row_key", "positions")), partner.column("doc_id"), partner.column("row_key"), _begins(rows, partner)]
    return pa.RecordBatch.from_arrays(columns, names=_PARTNER_NAMES)


def _same(row: pa.RecordBatch, n: int) -> pa.RecordBatch:
    return row.take(pa.array(np.zeros(n, np.int64)))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with another of its key. What has none here is told if its key may go on in another range, as is a row of every such key."""
    first: pa.RecordBatch | None = None  # of the key whose rows are still coming
    alone, edge = False, True

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        copies = first.column("copies")[0].as_py()
        if alone and copies > 1:  # a row that repeats is held by its own copy
            yield _with_partner(first, DECIDED, first)
        elif alone and (edge or last):
            yield _with_partner(first, OPEN, first)
        if edge or last:
            yield _with_partner(first, COUNT, first)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
        begin = np.concatenate([[0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1])
        size = np.diff(np.append(begin, n))
        at = 0
        if first is not None and (first.column(0)[0].as_py(), first.column(1)[0].as_py()) == (int(h1[0]), int(h2[0])):
            more = batch.slice(0, int(size[0]))
            if alone:
                yield _with_partner(first, DECIDED, more.slice(0, 1))
                alone = False
            yield _with_partner(more, DECIDED, _same(first, more.num_rows))
            at = 1
        if at == len(begin):
            continue
        if first is not None:
            yield from close(False)
            edge = False
        begin, size = begin[at:], size[at:]
        # the first of a run goes with the second, all others with the first
        partner = np.repeat(begin, size)
        many = size > 1
        partner[begin[many] - begin[0]] = begin[many] + 1
        rows = np.arange(int(begin[0]), n)
        take = np.repeat(many, size)
        if take.any():
            yield _with_partner(batch.take(pa.array(rows[take])), DECIDED, batch.take(pa.array(partner[take])))
        copied = ~many & (batch.column("copies").to_numpy()[begin] > 1)
        copied[-1] = False  # may go on, and is told when it is closed
        if len(begin) > 1:
            head = edge and at == 0 and first is None
            first, alone = batch.slice(int(begin[0]), 1), size[0] == 1
            if head:
                copied[0] = False
                yield from close(False)
                edge = False
            if copied.any():
                own = batch.take(pa.array(begin[copied]))
                yield _with_partner(own, DECIDED, own)
        first, alone = batch.slice(int(begin[-1]), 1), bool(size[-1] == 1)
    if first is not None:
        yield from close(True)


def _key_row(key: tuple[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([[]], pa.list_(pa.int32()))], schema=_ARROW)


def counted_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, copies, text: each id and text once. A row is known by its id and a hash of its text, as ids may repeat."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_key"), F.col("text").cast("string").alias("text"))
    told = keyed.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("copies"))
    if not told.filter("copies > 1").limit(1).count():
        return keyed.withColumn("copies", F.lit(1).cast("long"))
    # copies are combined before any text is moved
    return keyed.groupBy("doc_id", "row_key").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def _sorted(rows: DataFrame) -> DataFrame:
    order = ["h1", "h2", "doc_id", "row_key"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def frequent_positions(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, row_key, positions of the keys in at least ``least`` rows. ``rows``: ROWS, a row for each key of each document."""
    told = materialize(_sorted(rows).mapInArrow(_frequent(least), _OUT))
    totals = told.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)
    late = told.filter(F.col("kind") == OPEN).join(F.broadcast(totals), ["h1", "h2"], "left_semi")  # two keys a partition at most
    return told.filter(F.col("kind") == DECIDED).select("doc_id", "row_key", "positions").unionByName(late.select("doc_id", "row_key", "positions"))


def later_positions(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, positions of every occurrence of a key but its first in the order of documents and positions."""
    told = materialize(_sorted(rows).mapInArrow(_later, _OUT).withColumn("task", F.spark_partition_id()))
    ended = told.filter(F.col("kind") == COUNT).select("h1", "h2", "task").withColumnRenamed("task", "end")
    opened = told.filter(F.col("kind") == OPEN)
    # a range begins with a key that an earlier one ended with: its first row is a later occurrence
    again = opened.join(F.broadcast(ended), ["h1", "h2"], "left").groupBy("h1", "h2", "task", "doc_id", "row_key", "positions").agg(F.coalesce(F.min("end") < F.col("task"), F.lit(False)).alias("again"))
    late = again.select("doc_id", "row_key", F.when(F.col("again"), F.col("positions")).otherwise(F.slice("positions", 2, 1 << 30)).alias("positions")).filter(F.size("positions") > 0)
    return told.filter(F.col("kind") == DECIDED).select("doc_id", "row_key", "positions").unionByName(late)


def partnered_positions(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, positions, p_doc, p_row, p_begins: every row whose key another row has too, with one such row and where that has it.

    ``rows``: ROWS, a row for each key of each document. p_begins goes beside the pairs of
    positions, the k-th with the k-th, and with the last where it is the shorter. A row that
    stands for several copies goes with itself where nobody else has its key.
    """
    told = materialize(_sorted(rows).mapInArrow(_partners, _PARTNER))
    partner = F.struct("p_doc", "p_row", "p_begins")
    held = told.filter(F.col("kind") == COUNT).select("h1", "h2", partner.alias("f"))
    other = ~(F.col("f.p_doc").eqNullSafe(F.col("doc_id")) & F.col("f.p_row").eqNullSafe(F.col("row_key")))
    some = F.slice("f.p_begins", F.lit(1), F.expr("cast(size(positions) div 2 AS int)"))
    mine = ["doc_id", "row_key", "positions"]
    opened = told.filter(F.col("kind") == OPEN).select("h1", "h2", *mine)
    late = opened.join(F.broadcast(held), ["h1", "h2"]).filter(other)  # two keys a partition at most
    late = late.groupBy(*mine).agg(F.min("f").alias("f")).select(*mine, "f.p_doc", "f.p_row", some.alias("p_begins"))
    # a key of many ranges has one partner for all of them, its first row, and not one a range
    first = held.groupBy("h1", "h2").agg(F.min("f").alias("f"))
    decided = told.filter(F.col("kind") == DECIDED).join(F.broadcast(first), ["h1", "h2"], "left")
    theirs = F.col("f").isNotNull() & other
    chosen = [F.when(theirs, there).otherwise(F.col(c)).alias(c) for c, there in (("p_doc", F.col("f.p_doc")), ("p_row", F.col("f.p_row")), ("p_begins", some))]
    return decided.select(*mine, *chosen).unionByName(late)
