"""Exact Jaccard join of word shingles, answered with classes and components.

Documents of equal shingle sets are one class. Each class sends its rarest shingles
(enough that two classes that link must share one of them) to tiles; in a tile, classes
stand in the order of their sizes, so that each meets only the band of sizes that can
reach the limit. Bitmaps of shingle parities, longer for larger sets, bound the overlap
from above by a bit count; only pairs that pass are put to the exact intersection of
sorted arrays.

Large tiles are dealt out in parts of bounded size. Links are gathered so that a group
of n copies costs n pairs and not n squared: first each class is tried with the nearest
one before it in its part of a tile. Only tiles in which components still meet are
looked at again, and there only pairs across components, each row outside of the largest
component visiting every block; classes between which a pair passes become
neighbourhoods, and in each of these all pairs across components are put to the exact
test, in blocks, until links found have joined them. Pairs that pass are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches
from graphstrata.llm.hashing import Block, Sums, blocks, mix
from graphstrata.llm.skew import join_counted
from graphstrata.operators.components import connected_components
from graphstrata.runtime import discard, materialize

WORDS = 5
#: Two sets link when LINK_OVER * intersection >= LINK_UNDER * union.
LINK_OVER, LINK_UNDER = 100, 80
_STEP = np.uint64(0xA24BAED4963EE407)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bits of a bitmap that is sent to tiles. Beyond the most, a longer one would weigh more than it spares, as a text's tiles grow with
#: its length too; what such a one lets pass is told apart by the long bitmaps made from the arrays.
_LEAST_BITS, _MOST_BITS = 256, 1 << 14
#: Bits of the second bitmap, which is asked about fewer pairs, for each of the first.
_FINER = 2
_LEAST_FINE_BITS = 1024
#: A shingle is common when in so large a share of documents; it then stands last in every class's order.
_COMMON_SHARE, _COMMON_LEAST = 1 / 1000, 64
#: Documents and shingles counted together before shingles found fewer times are forgotten.
_COUNTED_DOCS, _COUNTED_SHINGLES, _COMMON_IN_COUNT = 4096, 1_000_000, 4
_CHUNK_BYTES, _CHUNK_PAIRS, _XOR_BYTES = 4 << 20, 100_000, 4 << 20
#: Rows of a tile's part, one in how many is a guest of the next part, rows of a block, shingles of a block of arrays, where an array
#: weighs as much as so many more, and pairs tried at once.
_TILE_ROWS, _GUESTS, _BLOCK_ROWS, _BLOCK_SHINGLES, _ROW_WEIGHT, _TRIED = 512, 16, 192, 200_000, 2000, 64
#: Ids that are broadcast (at most 16 MB) before a Bloom filter is, and the logarithm of its most bits (32 MB).
_BROADCAST_IDS, _MOST_FILTER_BITS = 500_000, 28
_ONE_TASK_LINKS = 200_000
_KEYS = ("grp", "block", "slice")


# ---------------------------------------------------------------- sets of shingles


def _block_sets(block: Block) -> Iterator[np.ndarray]:
    data = _LOWER[block.data]
    edge = np.diff((~_BLANK[data]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    words = Sums(data).hashes(begin, end)
    rolled = words[: max(len(words) - WORDS + 1, 0)]
    for k in range(1, WORDS):
        rolled = rolled * _STEP + words[k : len(words) - WORDS + 1 + k]
    rolled = mix(rolled)
    for lo, hi in zip(np.searchsorted(begin, block.begin), np.searchsorted(begin, block.end), strict=True):
        if hi - lo >= WORDS:
            found = np.sort(rolled[lo : hi - WORDS + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif hi > lo:
            whole = np.full(1, hi - lo, np.uint64)
            for w in words[lo:hi]:
                whole = mix(whole * _STEP + w)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    for block in blocks(texts, b" "):
        yield from _block_sets(block)


def prefix_of(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """As many of the set as it can lack in a set that it links with, and one more; common shingles last."""
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        usual = common[at] == found
        found = np.concatenate([found[~usual], found[usual]])
    needed = -(-LINK_UNDER * len(found) // LINK_OVER)
    return found[: len(found) - needed + 1]


def bits_of(n: int) -> int:
    return min(max(_LEAST_BITS, 1 << int(n - 1).bit_length()), _MOST_BITS)


def bitmap_of(found: np.ndarray, bits: int) -> bytes:
    """A bit for each residue: whether an odd number of shingles fall on it. Half the length is the two halves' exclusive or."""
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _longs(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    raw = b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets])
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _often(sets: list[np.ndarray]) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    often = n >= _COMMON_IN_COUNT
    return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for block in blocks(batch.column("text"), b" "):
            sets = list(_block_sets(block))
            held += sets
            size += sum(map(len, sets))
            if len(held) >= _COUNTED_DOCS or size >= _COUNTED_SHINGLES:
                yield _often(held)
                held, size = [], 0
    if held:
        yield _often(held)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of about a thousandth of all documents or more, sorted.

    All documents are counted, some thousands at a time; what is found fewer than four
    times among them is forgotten there, so counts fall short where documents are long:
    with documents of 2 KB the shingles of a five-hundredth of them are found almost
    surely, with 20 KB those of a fiftieth. Which ones are found changes what is compared
    but not what links: any order of shingles is right as long as all use the same. At
    most a thousand times the mean set size can be so common, whatever the input.
    """
    least = max(_COMMON_LEAST, int(docs.count() * _COMMON_SHARE))
    found = docs.select("text").mapInArrow(_counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= least).select("shingle").toArrow()
    return np.sort(rows.column("shingle").to_numpy().view(np.uint64))


def _described(common: np.ndarray):
    names = ["doc_id", "n", "d1", "d2", "prefix", "bitmap", "fine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in blocks(batch.column("text"), b" "):
                sets = list(_block_sets(block))
                halves = _digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(done, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                        _longs([prefix_of(s, common) if len(s) else s for s in sets]), pa.array([bitmap_of(s, bits_of(len(s))) if len(s) else b"" for s in sets], pa.binary()),
                        pa.array([bitmap_of(s, max(_LEAST_FINE_BITS, _FINER * bits_of(len(s)))) if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=names,
                )
                done += len(sets)

    return run


# ---------------------------------------------------------------- groups, dealt out in blocks


def _reach(n: np.ndarray) -> np.ndarray:
    """The smallest set size that can link with each size."""
    return -(-LINK_UNDER * n // LINK_OVER)


def _further(n: np.ndarray) -> np.ndarray:
    """The largest set size that can link with each size."""
    return n * LINK_OVER // LINK_UNDER


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of shingle and size, those beside another of a size in reach.

    A tile may begin in an earlier task or go on in a later one: a task's first and last
    row always stay.
    """
    held = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else _one([held, batch])
        shingle, n = held.column("shingle").to_numpy(), held.column("n").to_numpy()
        near = (shingle[1:] == shingle[:-1]) & (n[:-1] >= _reach(n[1:]))
        # the last row, and whether the one before it stays with it, is known with the next batch
        keep = np.concatenate([[first], near]) | np.concatenate([near, [False]])
        told = len(n) - 1
        yield held.slice(0, told).filter(pa.array(keep[:told]))
        if told:
            first = bool(near[-1])
        held = held.slice(told)
    if held is not None:
        yield held


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    batches = pa.Table.from_batches(parts).combine_chunks().to_batches()
    if len(batches) > 1:
        raise ValueError("rows that belong together are too large for one batch")
    return batches[0] if batches else parts[0]


class _Bitmaps:
    """Bitmaps as matrices by length; a shorter one is the exclusive or of a longer one's halves, made when it is asked for."""

    def __init__(self, raw: list[bytes]):
        self.level = np.array([len(r) for r in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.matrix: dict[int, np.ndarray] = {}
        self.folded: dict[tuple[int, int], np.ndarray] = {}
        for size in np.unique(self.level).tolist():
            own = np.flatnonzero(self.level == size)
            self.place[own] = np.arange(len(own))
            self.matrix[size] = np.frombuffer(b"".join([raw[i] for i in own]), np.uint64).reshape(len(own), -1)

    def _at(self, size: int, rows: np.ndarray) -> np.ndarray:
        """The bitmaps of rows, all of one length, at ``size``."""
        level = int(self.level[rows[0]])
        if level == size:
            return self.matrix[size][self.place[rows]]
        if (level, size) not in self.folded:
            m = self.matrix[level]
            while m.shape[1] * 8 > size:
                m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
            self.folded[level, size] = m
        return self.folded[level, size][self.place[rows]]

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        x, y = self.level[a], self.level[b]
        kind = x * (1 << 32) + y
        for k in np.unique(kind):
            pick = np.flatnonzero(kind == k)
            size = int(min(x[pick[0]], y[pick[0]]))
            step = max(1, _XOR_BYTES // size)
            for at in range(0, len(pick), step):
                some = pick[at : at + step]
                out[some] = np.bitwise_count(self._at(size, a[some]) ^ self._at(size, b[some])).sum(axis=1)
        return out


class _Chunk:
    """Rows of whole keys (group, block and slice): a block's own, by key and size, and those that ask, the probes."""

    def __init__(self, batch: pa.RecordBatch):
        names = batch.schema.names
        self.n, self.cls = batch.column("n").to_numpy(), batch.column("cls").to_numpy()
        self.component, self.probe = batch.column("component").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
        side, new = batch.column("side").to_numpy(), np.zeros(batch.num_rows, bool)
        for c in _KEYS:
            values = batch.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        key = np.cumsum(new)
        own = np.flatnonzero(side == 0)
        self.own = own[np.lexsort((self.n[own], key[own]))]
        # a block's own probes ask in its first slice only
        self.asking = np.flatnonzero(self.probe & ((side == 1) | (batch.column("slice").to_numpy() == 0)))
        span = np.int64(_further(self.n.max()) + 1) if len(self.n) else 1
        order, asked = key[self.own] * span + self.n[self.own], key[self.asking] * span
        self.low = np.searchsorted(order, asked + _reach(self.n[self.asking]))
        self.high = np.searchsorted(order, asked + _further(self.n[self.asking]), "right")
        if "shingles" in names:
            column = batch.column("shingles")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            self.sets = [flat[lo:hi] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            # made here, a bitmap has no weight on the way: long enough to tell sets apart that nearly link
            self.bitmaps = _Bitmaps([bitmap_of(s, max(_LEAST_FINE_BITS, 1 << int(8 * len(s) - 1).bit_length())) for s in self.sets])
        else:
            self.bitmaps = _Bitmaps(batch.column("bitmap").to_pylist())

    def across(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Probe, own row and differing bits of the pairs in reach of different components that pass; of two probes, the later class asks."""
        for p, at in _pairs(self.low, self.high, self.asking):
            r = self.own[at]
            apart = (self.component[p] != self.component[r]) & (~self.probe[r] | (self.cls[p] > self.cls[r]))
            p, r = p[apart], r[apart]
            if len(p):
                differ = self.bitmaps.differing(p, r)
                ok = _can_link(self.n[p], self.n[r], differ)
                yield p[ok], r[ok], differ[ok]


def _can_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The overlap is (sizes - difference) / 2 at most, and the bits that differ are no more than the difference."""
    most = (n + m - differ) // 2
    return LINK_OVER * most >= LINK_UNDER * (n + m - most)


def _pairs(low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``rows`` with every number from its low to its high, a bounded number of pairs at a time."""
    count = np.maximum(high - low, 0)
    rows, low, count = rows[count > 0], low[count > 0], count[count > 0]
    cut = np.flatnonzero(np.diff(np.cumsum(count) // _CHUNK_PAIRS)) + 1
    for r, lo, c in zip(np.split(rows, cut), np.split(low, cut), np.split(count, cut), strict=True):
        total = int(c.sum())
        left = np.repeat(r, c)
        right = np.arange(total) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)
        for at in range(0, total, _CHUNK_PAIRS):
            yield left[at : at + _CHUNK_PAIRS], right[at : at + _CHUNK_PAIRS]


def _gathered(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their keys anew, in batches cut between keys. What is dealt to one key is bounded."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= _CHUNK_BYTES:
            same = np.ones(batch.num_rows, bool)
            for k in keys:
                same &= batch.column(k).to_numpy() == held[-1].column(k)[held[-1].num_rows - 1].as_py()
            cut = batch.num_rows if same.all() else int(np.argmin(same))
            held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            yield _one(held)
            batch = batch.slice(cut)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield _one(held)


# ---------------------------------------------------------------- what is done in a block


def _best_of(cls: np.ndarray, other: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair of the fewest differing bits for each class."""
    order = np.lexsort((other, differ, cls))
    order = order[np.concatenate([[True], cls[order][1:] != cls[order][:-1]])] if len(order) else order
    return cls[order], other[order], differ[order]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a part the nearest one before it that passes (with differ), and the tiles in which a pair of it passes (with shingle)."""
    names = ["cls", "guest", "other", "differ", "shingle"]
    for batch in _gathered(batches, ("shingle", "part")):
        shingle, part = batch.column("shingle").to_numpy(), batch.column("part").to_numpy()
        n, cls = batch.column("n").to_numpy(), batch.column("cls").to_numpy()
        guest = batch.column("guest").to_numpy(zero_copy_only=False)
        tile = np.concatenate([[0], np.cumsum((shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1]))])
        span = np.int64(n.max() + 1)
        low = np.searchsorted(tile * span + n, tile * span + _reach(n))
        bitmaps = _Bitmaps(batch.column("bitmap").to_pylist())
        alive = batch.column("large").to_numpy(zero_copy_only=False) & ~guest
        found = [(np.zeros(0, np.int64),) * 3]
        rows = np.arange(len(n))
        for b, a in _pairs(low, rows, rows):
            differ = bitmaps.differing(a, b)
            ok = _can_link(n[a], n[b], differ)
            a, b = a[ok], b[ok]
            alive[a] = alive[b] = True
            found.append(_best_of(cls[b] * 2 + guest[b], cls[a], differ[ok]))
        who, other, differ = _best_of(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(who >> 1), pa.array((who & 1).astype(bool)), pa.array(other), pa.array(differ), pa.nulls(len(who), pa.int64())], names=names)
        alive &= ~guest
        none = pa.nulls(int(alive.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(cls[alive]), pa.array(np.zeros(int(alive.sum()), bool)), none, none, pa.array(shingle[alive])], names=names)


def _lowered(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of both ends of each pair. A label is the lowest number of its set, before and after."""
    while True:
        x, y = labels[a], labels[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y) that connect all classes between which a pair passes: never more than rows, however many pairs there are."""
    for batch in _gathered(batches, _KEYS):
        chunk = _Chunk(batch)
        labels, touched = np.arange(batch.num_rows), np.zeros(batch.num_rows, bool)
        for p, r, _ in chunk.across():
            _lowered(labels, p, r)
            touched[p] = touched[r] = True
        if touched.any():
            yield pa.RecordBatch.from_arrays([pa.array(chunk.cls[touched]), pa.array(chunk.cls[labels[touched]])], names=["x", "y"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (x, y) that connect what links in a block, by exact intersection of sorted arrays.

    A pair whose components links of this batch have joined already is not tried again.
    """
    for batch in _gathered(batches, _KEYS):
        chunk = _Chunk(batch)
        up: dict[int, int] = {}

        def root(c: int, up: dict[int, int] = up) -> int:
            while (d := up.get(c, c)) != c:
                up[c] = up.get(d, d)
                c = d
            return c

        xs, ys = [], []
        for p, r, differ in chunk.across():
            order = np.lexsort((differ, p))
            p, r = p[order], r[order]
            edge = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)]])
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if lo == hi:
                    continue
                own, mine = chunk.sets[p[lo]], int(chunk.component[p[lo]])
                for some in np.split(r[lo:hi], np.arange(_TRIED, hi - lo, _TRIED)):
                    some = some[[root(int(c)) != root(mine) for c in chunk.component[some]]]
                    if not len(some):
                        continue
                    others = [chunk.sets[i] for i in some]
                    size = np.array([len(o) for o in others])
                    flat = np.concatenate(others)
                    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                    both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
                    for i in some[LINK_OVER * both >= LINK_UNDER * (len(own) + size - both)]:
                        a, b = root(mine), root(int(chunk.component[i]))
                        if a != b:
                            up[max(a, b)] = min(a, b)
                            xs.append(int(chunk.cls[p[lo]]))
                            ys.append(int(chunk.cls[i]))
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])


# ---------------------------------------------------------------- arrays of the classes that need them


def _id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter over the ids, as longs; it only spares work, an exact join follows."""
    places = ids.select(F.explode(F.array(*_places(bits))).alias("p"))
    words = places.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def _places(bits: int) -> list[F.Column]:
    return [F.shiftrightunsigned(F.xxhash64(F.lit(k), "doc_id"), 64 - bits) for k in range(2)]


def _arrays(bits):
    names = ["_doc", "_d1", "_d2", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            if bits is not None:
                held = np.ones(some.num_rows, bool)
                for c in ("p0", "p1"):
                    p = some.column(c).to_numpy()
                    held &= (bits.value[p >> 6] >> (p & 63)) & 1 == 1
                some = some.filter(pa.array(held))
            done = 0
            for block in blocks(some.column("text"), b" "):
                sets = list(_block_sets(block))
                halves = _digests(sets)
                ids = some.column("doc_id").slice(done, len(sets))
                done += len(sets)
                once = np.array(list({k: i for i, k in enumerate(zip(ids.to_pylist(), *halves.T.tolist(), strict=True))}.values()))  # a repeated row's array is sent once from here
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(once)), pa.array(halves[once, 0]), pa.array(halves[once, 1]), _longs([sets[i] for i in once])], names=names)

    return run


def _with_arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, d1, d2 and more) with shingles, from another reading of the text.

    Up to a counted number of documents their ids are broadcast, and only their texts
    are read on; above, a Bloom filter of the ids does, up to a fixed size: where it is
    too full to help, the arrays of other documents are moved too, and dropped by the join.
    """
    few = wanted.count()
    schema = "_doc long, _d1 long, _d2 long, shingles array<long>"
    if few <= _BROADCAST_IDS:
        ids = F.broadcast(wanted.select(F.col("doc_id").alias("_id")).distinct())
        read = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("doc_id", "text").mapInArrow(_arrays(None), schema)
    else:
        size = min(max(12, int(10 * few - 1).bit_length()), _MOST_FILTER_BITS)
        bits = docs.sparkSession.sparkContext.broadcast(_id_filter(wanted, size))
        p0, p1 = _places(size)
        read = docs.select("doc_id", "text", p0.alias("p0"), p1.alias("p1")).mapInArrow(_arrays(bits), schema)
    same = F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_d1") == F.col("d1")) & (F.col("_d2") == F.col("d2"))
    return read.join(wanted, same, "inner").drop("_doc", "_d1", "_d2")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose exact intersection reaches the limit. A class's own array comes first, then those of the others it is to be tried with."""
    key, own, before = None, None, None
    for batch in batches:
        x, y = batch.column("x").to_numpy(), batch.column("cls").to_numpy()
        column = batch.column("shingles")
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        out = []
        for i in range(len(x)):
            if (x[i], y[i]) == before:
                continue  # a row that the documents repeat
            before = x[i], y[i]
            array = flat[offsets[i] : offsets[i + 1]]
            if x[i] == y[i]:
                key, own = x[i], array.copy()
                continue
            if key != x[i]:
                raise ValueError(f"class {x[i]} has no array")
            at = np.minimum(np.searchsorted(own, array), len(own) - 1)
            both = int((own[at] == array).sum())
            if LINK_OVER * both >= LINK_UNDER * (len(own) + len(array) - both):
                out.append((x[i], y[i]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["x", "y"])


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """x, y of the pairs that link.

    An array is sent once for each pair, to the other's place, and once to its own. A class
    is x for no more pairs than its parts of tiles have rows, so no place is hot.
    """
    sent = pairs.select(F.col("y").alias("cls"), "x", F.lit(1).alias("side")).unionByName(pairs.select(F.col("x").alias("cls"), "x", F.lit(0).alias("side")))
    wanted = sent.groupBy("cls").agg(F.collect_set(F.struct("x", "side")).alias("to")).join(classes.select("cls", "doc_id", "d1", "d2"), "cls")
    read = _with_arrays(docs, materialize(wanted)).select("cls", F.explode("to").alias("to"), "shingles").select("cls", "to.*", "shingles")
    return materialize(read.repartition("x").sortWithinPartitions("x", "side", "cls").mapInArrow(_linked, "x long, y long"))


# ---------------------------------------------------------------- the join


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _part_of(k: F.Column, *salt: str) -> F.Column:
    return F.pmod(F.xxhash64("cls", *salt), k).cast("int")


def _in_parts(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of tiles with bitmaps, large tiles dealt out in parts by a hash.

    Each part also gets, as guests, a share of the next one's rows, so that links found
    inside parts can lead from part to part.
    """
    sizes = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > _TILE_ROWS)
    parts = F.ceil(F.col("m") / _TILE_ROWS)
    placed = join_counted(met, materialize(sizes.select("shingle", parts.alias("k"))), "shingle", "cls").withColumn("large", F.col("k").isNotNull()).withColumn("k", F.coalesce("k", F.lit(1)))
    own = placed.withColumn("part", _part_of(F.col("k")))
    visits = F.col("large") & (F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(_GUESTS)) == 0)
    here = F.struct(F.col("part"), F.lit(False).alias("guest"))
    there = F.struct(F.pmod(F.col("part") + 1, F.col("k")).cast("int").alias("part"), F.lit(True).alias("guest"))
    rows = own.withColumn("to", F.explode(F.when(visits, F.array(here, there)).otherwise(F.array(here)))).select("shingle", "cls", "large", "to.*")
    return rows.join(classes.select("cls", "n", "bitmap"), "cls")


def _dealt(rows: DataFrame, weight: F.Column, most: int) -> DataFrame:
    """Rows (grp, cls, component) of the groups that hold more than one component, with the blocks of about ``most`` of ``weight`` that they go to.

    Each row lies in one block (side 0). Rows outside of their group's largest component
    are probes: they also visit the other blocks (side 1). So a pair of different
    components meets, and a group of one component and a few stragglers costs no more
    than its rows times the stragglers' blocks. Many probes visit in slices of ``most``, a
    block's rows going to each slice, so no task gets more of a group than a block and a slice.
    """
    each = rows.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(weight).alias("w"))
    top = F.max(F.struct("c", (-F.col("component")).alias("neg"), "w"))
    groups = each.groupBy("grp").agg(F.count(F.lit(1)).alias("kinds"), F.sum("w").alias("w"), top.alias("top")).filter(F.col("kinds") > 1)
    pieces = lambda w: F.greatest(F.ceil(w / most), F.lit(1)).cast("int")
    groups = materialize(groups.select("grp", pieces(F.col("w")).alias("k"), pieces(F.col("w") - F.col("top.w")).alias("slices"), (-F.col("top.neg")).alias("largest")))
    # Spark splits what a large group makes of this join
    placed = rows.join(groups, "grp").withColumn("own", _part_of(F.col("k"), "grp")).withColumn("probe", F.col("component") != F.col("largest")).withColumn("slice", _part_of(F.col("slices"), "component"))
    at_home = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.struct(F.col("own").alias("block"), j.alias("slice"), F.lit(0).alias("side")))
    others = F.array_except(F.sequence(F.lit(0), F.col("k") - 1), F.array("own"))
    visits = F.transform(others, lambda b: F.struct(b.alias("block"), F.col("slice"), F.lit(1).alias("side")))
    return placed.withColumn("to", F.when(F.col("probe"), F.concat(at_home, visits)).otherwise(at_home)).drop("k", "own", "largest", "slice", "slices")


def _in_blocks(rows: DataFrame, run, schema: str) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, schema)


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links, "x", "y", one_task_rows=_ONE_TASK_LINKS).withColumnsRenamed({"node": "cls"})


def _joined(slim: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, d1, d2), classes (cls, d1, d2, doc_id of the smallest id, and more), and links (x, y) enough to connect them."""
    bounded_batches(slim.sparkSession)
    common = common_shingles(slim)
    whole = materialize(slim.mapInArrow(_described(common), "doc_id long, n long, d1 long, d2 long, prefix array<long>, bitmap binary, fine binary"))
    described = materialize(whole.select("doc_id", "n", "d1", "d2"))
    first = [F.any_value(c).alias(c) for c in ("n", "prefix", "bitmap", "fine")]
    classes = materialize(whole.filter(F.col("n") > 0).groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), *first).withColumn("cls", F.monotonically_increasing_id()))
    discard(whole)

    rows = classes.select(F.explode("prefix").alias("shingle"), "n", "cls")
    met = materialize(rows.repartitionByRange("shingle", "n", "cls").sortWithinPartitions("shingle", "n", "cls").mapInArrow(_meetings, "shingle long, n long, cls long").select("shingle", "cls"))

    # first, each class is tried with the nearest in its part of each tile
    parted = _in_parts(met, classes).repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n", "cls")
    near = materialize(parted.mapInArrow(_nearest, "cls long, guest boolean, other long, differ long, shingle long"))
    discard(met)
    nearest = near.filter(F.col("differ").isNotNull()).groupBy("cls", "guest").agg(F.min_by("other", F.struct("differ", "other")).alias("other"))
    links = _verified(slim, classes, materialize(nearest.select(F.col("other").alias("x"), F.col("cls").alias("y")).distinct()))

    # tiles in which components still meet: who passes with whom, as neighbourhoods
    def placed(df: DataFrame, joined: DataFrame) -> DataFrame:
        return df.join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))

    joined = materialize(_components(links))
    alive = near.filter(F.col("shingle").isNotNull()).select(F.col("shingle").alias("grp"), "cls")
    still = materialize(_dealt(placed(alive, joined), F.lit(1), _BLOCK_ROWS).withColumn("to", F.explode("to")).select("grp", "to.*", "cls", "component", "probe"))
    discard(near)
    tried = _in_blocks(still.join(classes.select("cls", "n", F.col("fine").alias("bitmap")), "cls"), _neighbourhoods, "x long, y long")
    around = materialize(_components(materialize(tried.distinct())).withColumnsRenamed({"component": "grp"}))
    discard(still)

    # and in each neighbourhood, all that is left to try, once
    sized = placed(around.join(classes.select("cls", "n", "doc_id", "d1", "d2"), "cls"), joined)
    wanted = materialize(_dealt(sized, F.col("n") + _ROW_WEIGHT, _BLOCK_SHINGLES))
    read = _with_arrays(slim, wanted).withColumn("to", F.explode("to")).select("grp", "to.*", "cls", "component", "probe", "n", "shingles")
    late = materialize(_in_blocks(read, _links, "x long, y long"))
    return described, classes, materialize(links.unionByName(late))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links, component_id for each row of ``docs``.

    class_id is the smallest id of the documents of the same shingle set, n_links how
    many linked pairs of its class were written down to connect it (enough for the
    components, not all), component_id the smallest id that links lead to. Null and
    empty texts have an empty set, no class but their own id, and no links. Repeated
    rows are documents of one class. A null id is never the smallest of its class
    unless all are null. An empty table gives an empty result; other columns are not read.
    """
    described, classes, links = _joined(_slim(docs))
    joined = connected_components(links, "x", "y")
    ends = links.select(F.explode(F.array("x", "y")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("cls", "d1", "d2", "doc_id").join(joined.withColumnRenamed("node", "cls"), "cls").join(ends, "cls", "left")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("cls", "d1", "d2", F.col("doc_id").alias("class_id")).join(named.join(smallest, "component").select("cls", "component_id", "n_links"), "cls", "left")
    of_class = of_class.select("d1", "d2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    linked = described.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("d1")).alias("d1"), F.when(F.col("n") > 0, F.col("d2")).alias("d2")).join(of_class, ["d1", "d2"], "left")
    return linked.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _digest_of(text: pa.Array) -> pa.Array:
    halves = np.concatenate([np.zeros((0, 2), np.int64), *(_digests(list(_block_sets(block))) for block in blocks(text, b" "))])
    return pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["d1", "d2"])


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id, with its columns as they were.

    Rows are told apart by id and shingle set, so that of rows that repeat an id each
    stays that is the smallest of its own component; of rows alike in both one stays.
    A null id is the smallest only where all are null. Documents without words all stay,
    as they link with nothing.
    """
    described, classes, links = _joined(_slim(docs))
    parts = connected_components(links, "x", "y").withColumnRenamed("node", "cls")
    placed = classes.select("cls", "doc_id", "d1", "d2").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2")).alias("first"))
    stays = first.select(F.col("first.doc_id").alias("_id"), F.col("first.d1").alias("_f1"), F.col("first.d2").alias("_f2"), F.lit(True).alias("_one"))
    rows = described.filter(F.col("n") > 0).groupBy("doc_id", "d1", "d2").agg(F.count(F.lit(1)).alias("copies"))
    told = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("d1") == F.col("_f1")) & (F.col("d2") == F.col("_f2")), "left").filter("_one IS NULL OR copies > 1")
    # the rows to drop (_one is false) and those of which one stays: few beside the documents
    told = materialize(told.select(F.col("doc_id").alias("_id"), F.col("d1").alias("_t1"), F.col("d2").alias("_t2"), F.coalesce("_one", F.lit(False)).alias("_one")))
    shared = materialize(described.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id"))
    read = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"))
    by_id = F.col("_doc").eqNullSafe(F.col("_id"))
    if shared.isEmpty():
        return read.join(told.select("_id"), by_id, "left_anti").select("_row.*")
    # only rows that share their id are read for their sets once more
    digest = F.arrow_udf(_digest_of, "struct<d1:long,d2:long>")(F.col("_row.text").cast("string"))
    many = read.join(shared, by_id, "left_semi").withColumn("_key", digest)
    same = by_id & (F.col("_key.d1") == F.col("_t1")) & (F.col("_key.d2") == F.col("_t2"))
    alone = read.join(told.select("_id").union(shared).distinct(), by_id, "left_anti").select("_row")
    one = many.join(told.filter("_one"), same).dropDuplicates(["_id", "_t1", "_t2"]).select("_row")
    return alone.unionByName(many.join(told, same, "left_anti").select("_row")).unionByName(one).select("_row.*")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document of ``documents``; nulls, repeats and empty tables as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
split AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
pieces AS (
  SELECT rid, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM split WHERE len(ws) >= 5)
  UNION ALL SELECT rid, array_to_string(ws, ' ') FROM split WHERE len(ws) BETWEEN 1 AND 4),
sets AS (SELECT DISTINCT rid, s FROM pieces),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
both_ways AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ways JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach(rid, other) AS (
  WITH RECURSIVE r(rid, other) AS (SELECT rid, rid FROM docs UNION SELECT r.rid, links.y FROM r JOIN links ON links.x = r.other) SELECT rid, other FROM r),
same AS (SELECT rid, min(doc_id) OVER (PARTITION BY k) AS class_id FROM (SELECT docs.rid, doc_id, k FROM docs JOIN (SELECT rid, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sets GROUP BY rid) USING (rid))),
lowest AS (SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.rid = reach.other GROUP BY reach.rid)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(class_id, d.doc_id) AS class_id, component_id FROM docs d JOIN lowest ON lowest.rid = d.rid LEFT JOIN same ON same.rid = d.rid LEFT JOIN sizes ON sizes.rid = d.rid
"""
