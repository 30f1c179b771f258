"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; where it is small a chunk ends. As it sees only the
last few bytes, a passage that is inserted, moved or shifted is cut at the same places
again, and its chunks have the same digests. Keys are windows: a chunk with those that
follow it, up to some length. A document's windows that one other document holds in the
same order, next to one another, are a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches
from graphstrata.llm.hashing import Block, Sums, blocks
from graphstrata.llm.streamed import ROWS, counted_rows, partnered_positions
from graphstrata.runtime import materialize

#: Bytes that a boundary depends on, mean bytes between candidates, least and most bytes of a chunk.
REACH, SPACING, LEAST, MOST = 16, 18, 12, 512
#: A repeated passage is reported from so many characters on, and looked for by windows of so many.
LEAST_SPAN, WINDOW = 100, 60
_SEED = 20240407
_GEAR = np.random.default_rng(_SEED).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_BELOW = np.uint32((1 << 32) // SPACING)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the stretch that it has seen."""
    out = _GEAR[data]
    seen = 1
    while seen < REACH:
        older = np.zeros_like(out)
        older[seen:] = out[:-seen]
        out = out + (older << np.uint32(seen))
        seen *= 2
    return out ^ (out >> np.uint32(15))


def _cuts(candidates: list[int], begin: int, end: int, hashes: np.ndarray) -> list[int]:
    """The ends of a text's chunks: candidates no nearer than LEAST.

    Where none comes for MOST bytes, as in a short phrase repeated again and again, the
    chunk ends at the last of the smallest hashes among them, so there too the content
    says where, and not the distance from the chunk before.
    """
    out, last = [], begin

    def forced(last: int) -> int:
        near = hashes[last + LEAST - 1 : last + MOST]
        return last + LEAST + len(near) - 1 - int(np.argmin(near[::-1]))

    for c in candidates:
        if c - last < LEAST:
            continue
        while c - last > MOST:
            last = forced(last)
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while end - last > MOST:
        last = forced(last)
        out.append(last)
    if end > last:
        out.append(end)
    return out


def block_chunks(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number in the block, first and last byte in the buffer, and digest of every chunk."""
    hashes = gear(block.data)
    found = np.flatnonzero(hashes < _BELOW) + 1
    lo, hi = np.searchsorted(found, block.begin, "right"), np.searchsorted(found, block.end, "left")
    ends, counts = [], []
    for i in range(len(block.begin)):
        e = _cuts(found[lo[i] : hi[i]].tolist(), int(block.begin[i]), int(block.end[i]), hashes)
        ends += e
        counts.append(len(e))
    end, count = np.array(ends, np.int64), np.array(counts, np.int64)
    text = np.repeat(np.arange(len(count)), count)
    begin = np.concatenate([[0], end[:-1]]) if len(end) else end
    head = np.cumsum(count)[count > 0] - count[count > 0]
    begin[head] = block.begin[count > 0]
    return text, begin, end, Sums(block.data).hashes(begin, end)


def windows(text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of every window: from each chunk on the shortest of ``least`` characters, and the shortest that ends with the text.

    ``begin``, ``end``: places of chunks, which follow one another inside of a text.
    """
    n = len(text)
    stop = np.searchsorted(text, text, "right")  # one past the text's last chunk
    base = text.astype(np.int64) * (int(end.max()) + least + 1 if n else 0)  # texts one after another
    last = np.searchsorted(end + base, begin + base + least, "left")
    first = np.flatnonzero(last < stop)
    last = last[first]
    tails = np.unique(stop) - 1
    heads = np.searchsorted(begin + base, (end + base)[tails] - least, "right") - 1
    fits = (heads >= 0) & (text[np.maximum(heads, 0)] == text[tails])
    pairs = np.unique(np.concatenate([first, heads[fits]]) * n + np.concatenate([last, tails[fits]]))
    return np.divmod(pairs, max(n, 1))


def _window_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, row_keys, copies = (batch.column(c) for c in ("doc_id", "row_key", "copies"))
            for block in blocks(batch.column("text"), b"\0"):
                text, begin, end, _ = block_chunks(block)
                # places are counted in characters: bytes that go on with one do not count
                place = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                if not len(text):
                    continue
                own_first = place[block.begin][text]
                first, last = windows(text, place[begin] - own_first, place[end] - own_first, least)
                if not len(first):
                    continue
                digest = Sums(block.data).hashes(begin[first], end[last])
                spans = np.stack([place[begin[first]] - own_first[first], place[end[last]] - own_first[first]], axis=1).astype(np.int32)
                text = text[first]
                order = np.lexsort((spans[:, 0], digest, text))
                text, digest, spans = text[order], digest[order], spans[order]
                start = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])]))
                offsets = np.concatenate([start, [len(text)]]).astype(np.int32) * 2
                own = pa.array(text[start] + block.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digest[start].view(np.int64)), pa.array(np.zeros(len(start), np.int64)), doc_ids.take(own), row_keys.take(own), copies.take(own),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(spans.ravel())),
                    ],
                    names=["h1", "h2", "doc_id", "row_key", "copies", "positions"],
                )

    return run


def passages(spans: np.ndarray, partner: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """(begin, end) of what one partner holds whole, from ``least`` on: windows that meet, and lie as far from one another there as here. What lies within another passage is left out."""
    shift = place - spans[:, 0]
    order = np.lexsort((spans[:, 1], spans[:, 0], shift, partner))
    spans, partner, shift = spans[order], partner[order], shift[order]
    new = np.concatenate([[True], (partner[1:] != partner[:-1]) | (shift[1:] != shift[:-1])])
    # the farthest end so far in its group: groups are told apart by an offset
    group = np.cumsum(new) * (int(spans.max()) + 1)
    reach = np.maximum.accumulate(spans[:, 1] + group) - group
    new[1:] |= spans[1:, 0] > reach[:-1]
    start = np.flatnonzero(new)
    begin, end = spans[start, 0], np.maximum.reduceat(spans[:, 1], start)
    order = np.lexsort((-end, begin))
    begin, end = begin[order], end[order]
    before = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]])
    return np.stack([begin, end], axis=1)[(end > before) & (end - begin >= least)]


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows, found = [], [], []
            for i, (doc, row) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), strict=True)):
                held = batch.column("held")[i].values
                lists, p_doc, p_row, p_begins = held.flatten()
                counts = np.diff(lists.offsets.to_numpy()) // 2
                spans = lists.values.slice(lists.offsets[0].as_py(), int(counts.sum()) * 2).to_numpy().astype(np.int64).reshape(-1, 2)
                keys = [c.fill_null(-1).to_numpy(zero_copy_only=False) for c in (p_doc, p_row)]
                partner = np.unique(np.stack(keys), axis=1, return_inverse=True)[1].ravel()
                there = np.diff(p_begins.offsets.to_numpy())
                k = np.arange(len(spans)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.repeat(p_begins.offsets.to_numpy()[:-1], counts) + np.minimum(k, np.repeat(there - 1, counts))
                out = passages(spans, np.repeat(partner, counts), p_begins.values.to_numpy()[at].astype(np.int64), least)
                found.append(out)
                docs += [doc] * len(out)
                rows += [row] * len(out)
            spans = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, rows, spans[:, 0], spans[:, 1])], names=["doc_id", "row_key", "span_begin", "span_end"])

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST_SPAN) -> DataFrame:
    """doc_id, row_key, span_begin, span_end (characters, end exclusive) of passages of each document that one other document holds whole.

    What is told of a passage begins and ends with a chunk: up to a chunk may be missing at
    its start, and as much or less than WINDOW characters at its end; it has ``least`` characters or
    more. A window goes with the first document that has it, so a passage of which an
    earlier document holds a part is told in pieces. Passages may overlap, where different
    documents hold what overlaps; none lies within another. A row is a document: a repeated row repeats its whole text, and rows alike in
    id and text are told once. Null and empty texts have no passages; a null id stays null;
    a very long text is cut and read whole, in a block of its own. An empty table gives an
    empty result; other columns are not read. Windows go by digests of 64 bits.
    """
    bounded_batches(docs.sparkSession)
    rows = materialize(counted_rows(docs).mapInArrow(_window_rows(min(least, WINDOW)), ROWS))
    shared = partnered_positions(rows).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("positions", "p_doc", "p_row", "p_begins")).alias("held"))
    return shared.mapInArrow(_runs(least), "doc_id long, row_key long, span_begin long, span_end long")


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of ``documents`` that other documents hold too; nulls, repeats and empty tables as in ``repeated_spans``."""
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "span_begin", "span_end", (F.col("span_end") - F.col("span_begin")).alias("n_chars"))
