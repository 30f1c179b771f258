"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions and cut in slots; the slots of one
table make a bucket. A query visits its own bucket and those next to it in the order of
their estimated success: the nearer the query lies to a slot's edge, the sooner the slot
beyond is tried. How many directions a table has and how many buckets are visited is
fitted to the vectors: for a bounded sample of queries, whose true neighbours are looked
up among all vectors, it is the choice that finds the wanted share of them and visits
the fewest vectors.

Buckets hold ids and a code of two bytes for each component. In a bucket the codes are
compared; what may be among the nearest, as far as the codes can tell, is ranked by its
exact cosine, for which alone the vectors themselves are joined.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches
from graphstrata.llm.skew import join_counted
from graphstrata.runtime import materialize

#: Tables, width of a slot in units of a projection's deviation, most buckets visited of a table, and the share of neighbours to be found.
TABLES, WIDTH, MOST_PROBES, RECALL = 4, 2.0, 600, 0.95
#: Queries and vectors of the sample that the choice is fitted on, those of them that give a query's first bound, and the directions to choose from.
SAMPLE_QUERIES, SAMPLE_VECTORS, BOUND_VECTORS, DIRECTIONS = 64, 4096, 512, tuple(range(3, 33))
_SEED = 20240229
_HOT_BUCKET = 128
_STEPS = 32767
_MET = "query_id long, vec_id long, low double, high double"


class Choice(NamedTuple):
    """How a table is built and searched."""

    tables: int
    directions: int
    width: float
    probes: int


def projections(table: int, dims: int, directions: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The first directions of a table, whatever their number, and the offsets of its slots."""
    draw = lambda kind: np.random.default_rng([_SEED, kind, table, dims])
    return draw(0).standard_normal((directions, dims)).T, draw(1).random(directions) * width


def perturbations(place: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """Sets of (direction, step) by the sum of squared distances to the edges crossed, the empty set first."""
    k = len(place)
    cost = np.concatenate([place, 1 - place]) ** 2
    order = np.argsort(cost, kind="stable")
    cost, of, step = cost[order], order % k, np.where(order < k, -1, 1)
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if len({of[i] for i in chosen}) == len(chosen):
            out.append([(int(of[i]), int(step[i])) for i in chosen])
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(table: int, dims: int, slots: np.ndarray) -> np.ndarray:
    """One long for each row of slots; a chance clash only adds candidates."""
    out = np.full(len(slots), (table << 20) + dims, np.uint64)
    for column in slots.T:
        out = (out ^ column.astype(np.int64).view(np.uint64)) * _ODD
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    return [(rows, flat[begin[rows][:, None] + np.arange(d)]) for d in np.unique(sizes) for rows in [np.flatnonzero(sizes == d)]]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that no square overflows
    return m / np.linalg.norm(m, axis=1, keepdims=True)


# ---------------------------------------------------------------- codes


def codes(unit: np.ndarray) -> list[bytes]:
    """A float, the length of a step, then two bytes of steps for each component."""
    step = np.abs(unit).max(axis=1).astype(np.float32) / np.float32(_STEPS)
    steps = np.clip(np.rint(unit / step[:, None]), -_STEPS, _STEPS).astype("<i2")
    return [s.tobytes() + row.tobytes() for s, row in zip(step, steps, strict=True)]


class Coded(NamedTuple):
    """Row numbers of the codes of one length, what they stand for, and how far at most that is from the vectors: half a step in each component."""

    rows: np.ndarray
    m: np.ndarray
    off: np.ndarray


def _decoded(raw: list[bytes]) -> list[Coded]:
    size = np.array([len(r) for r in raw])
    out = []
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        m = np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8).reshape(len(rows), n)
        step, steps = np.ascontiguousarray(m[:, :4]).view("<f4"), np.ascontiguousarray(m[:, 4:]).view("<i2")
        out.append(Coded(rows, steps.astype(np.float32) * step, step[:, 0] * np.float32(math.sqrt(steps.shape[1]) / 2)))
    return out


def _off(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the product of two codes may be from the cosine of their vectors (Cauchy's inequality, and rounding)."""
    return a + b + a * b + np.float32(1e-5)


# ---------------------------------------------------------------- fitting the choice


def _ranks(query: np.ndarray, near: np.ndarray, of: np.ndarray, tables: int, directions: int, width: float, probes: int) -> np.ndarray:
    """For each row of ``near`` after how many buckets of its query's tables it is met; probes + 1 if never."""
    out = np.full(len(near), probes + 1)
    for t in range(tables):
        a, b = projections(t, query.shape[1], directions, width)
        at = (query @ a + b) / width
        home, there = np.floor(at), np.floor((near @ a + b) / width)
        for i in range(len(query)):
            mine = np.flatnonzero(of == i)
            steps = {tuple(s): k for k, s in zip(mine, (there[mine] - home[i]).astype(int).tolist(), strict=True) if max(map(abs, s)) <= 1}
            if not steps:
                continue
            for rank, moves in enumerate(perturbations(at[i] - home[i], probes)):
                key = [0] * directions
                for d, step in moves:
                    key[d] = step
                if tuple(key) in steps:
                    for k in mine:
                        if tuple((there[k] - home[i]).astype(int).tolist()) == tuple(key):
                            out[k] = min(out[k], rank + 1)
    return out


def _visited_share(query: np.ndarray, sample: np.ndarray, choice: Choice) -> float:
    """The share of the sample in the buckets that the queries visit."""
    seen = np.zeros((len(query), len(sample)), bool)
    for t in range(choice.tables):
        a, b = projections(t, query.shape[1], choice.directions, choice.width)
        keys = _bucket(t, query.shape[1], np.floor((sample @ a + b) / choice.width))
        at = (query @ a + b) / choice.width
        for i, visited in enumerate(_visits(t, query.shape[1], at, choice.probes)):
            seen[i] |= np.isin(keys, visited)
    return float(seen.mean())


def fit(query: np.ndarray, near: np.ndarray, of: np.ndarray, sample: np.ndarray, n: int) -> tuple[Choice, float, float]:
    """The choice that meets the wanted share of ``near`` (rows near[of == i] belong to query i) and costs least over n vectors; the share met, and the share of vectors visited.

    With more directions buckets are smaller and more of them must be visited. A bucket
    visited costs about as much as some vectors compared.
    """
    best = None
    for k in DIRECTIONS:
        rank = np.sort(_ranks(query, near, of, TABLES, k, WIDTH, MOST_PROBES))
        need = int(rank[min(len(rank) - 1, math.ceil(RECALL * len(rank)) - 1)]) if len(rank) else 1
        if need > MOST_PROBES and best is not None:
            break
        choice = Choice(TABLES, k, WIDTH, min(need, MOST_PROBES))
        share = _visited_share(query, sample, choice)
        cost = share * n + 8 * choice.tables * choice.probes
        if best is None or cost < best[0]:
            best = cost, choice, float((rank <= choice.probes).mean()) if len(rank) else 1.0, share
    return best[1:]


def _brute(queries: list[tuple[int, list[float]]], k: int):
    """The k best of each query among a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, matrix in _vectors(batch.column("v")):
                unit = _unit(matrix)
                same = [(i, v) for i, v in queries if len(v) == matrix.shape[1]]
                if not same:
                    continue
                asked = _unit(np.array([v for _, v in same]))
                cos = asked @ unit.T
                cos[np.array([i for i, _ in same])[:, None] == ids[rows][None, :]] = -2
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                q = np.repeat([i for i, _ in same], top.shape[1])
                at = top.ravel()
                score = np.take_along_axis(cos, top, 1).ravel()
                some = score > -2
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, int(some.sum()) * matrix.shape[1] + 1, matrix.shape[1], dtype=np.int32)), pa.array(unit[at[some]].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(q[some]), pa.array(ids[rows][at[some]]), pa.array(score[some]), v], names=["query_id", "vec_id", "score", "v"])

    return run


def choose(usable: DataFrame, queries: DataFrame, k: int) -> tuple[Choice, list[bytes], list[int]]:
    """The choice fitted to the vectors, and codes and ids of some sampled vectors.

    The sample is bounded: so many queries and vectors, drawn by a hash of their id. The
    neighbours of the sampled queries are looked up among all vectors.
    """
    drawn = F.xxhash64(F.lit(_SEED), "id")
    asked = [(r["id"], list(r["v"])) for r in queries.orderBy(drawn, "id").limit(SAMPLE_QUERIES).collect()]
    some = [(r["id"], list(r["v"])) for r in usable.orderBy(drawn, "id").limit(SAMPLE_VECTORS).collect()]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = usable.mapInArrow(_brute(asked, k), "query_id long, vec_id long, score double, v array<double>").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()
    dims = max({len(v) for _, v in asked}, key=lambda d: sum(len(v) == d for _, v in asked), default=0)
    asked = [(i, v) for i, v in asked if len(v) == dims]
    place = {i: at for at, (i, _) in enumerate(asked)}
    near = [r for r in near if r["query_id"] in place]
    same = [v for _, v in some if len(v) == dims]
    if not asked or not same or not near:
        return Choice(TABLES, DIRECTIONS[0], WIDTH, MOST_PROBES), [], []
    choice, _, _ = fit(_unit(np.array([v for _, v in asked])), np.array([r["v"] for r in near]), np.array([place[r["query_id"]] for r in near]), _unit(np.array(same)), usable.count())
    some = some[:BOUND_VECTORS]
    return choice, [codes(_unit(np.array([v])))[0] for _, v in some], [i for i, _ in some]


# ---------------------------------------------------------------- buckets


def _index(choice: Choice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, matrix in _vectors(batch.column("v")):
                unit = _unit(matrix)
                code = pa.array(codes(unit), pa.binary())
                for t in range(choice.tables):
                    a, b = projections(t, matrix.shape[1], choice.directions, choice.width)
                    key = _bucket(t, matrix.shape[1], np.floor((unit @ a + b) / choice.width))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[rows]), code], names=["bucket", "id", "code"])

    return run


def _visits(table: int, dims: int, at: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """The buckets that each row of places visits."""
    slots = np.floor(at)
    for i in range(len(at)):
        moves = perturbations(at[i] - slots[i], probes)
        visited = np.repeat(slots[i : i + 1], len(moves), 0)
        for row, steps in enumerate(moves):
            for d, step in steps:
                visited[row, d] += step
        yield _bucket(table, dims, visited)


def _probe(choice: Choice, sample, k: int):
    """id, code, the buckets to visit, and a score that the k-th best has at least, as the sample tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_ids = _decoded(sample.value[0]), np.array(sample.value[1], np.int64)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, matrix in _vectors(batch.column("v")):
                unit = _unit(matrix)
                code = codes(unit)
                least = np.full(len(rows), -2.0)
                for their in known:
                    if their.m.shape[1] == matrix.shape[1] and len(their.rows) > k:
                        low = unit.astype(np.float32) @ their.m.T - _off(np.float32(0), their.off)
                        low[ids[rows][:, None] == known_ids[their.rows][None, :]] = -2
                        least = np.partition(low, len(their.rows) - k, axis=1)[:, len(their.rows) - k].astype(np.float64)
                buckets = [[] for _ in rows]
                for t in range(choice.tables):
                    a, b = projections(t, matrix.shape[1], choice.directions, choice.width)
                    for i, keys in enumerate(_visits(t, matrix.shape[1], (unit @ a + b) / choice.width, choice.probes)):
                        buckets[i].append(keys)
                lists = [np.concatenate(x) for x in buckets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(code, pa.binary()), pa.array(least), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))],
                    names=["id", "code", "least", "buckets"],
                )

    return run


class _Ranker:
    """Keeps of each query what may be among its k best by the codes seen so far: bounds of the cosine, from below and above."""

    def __init__(self, asked: dict, k: int):
        self.asked, self.k, self.held, self.n = asked, k, [], 0

    def add(self, at: np.ndarray, ids: np.ndarray, m: np.ndarray, off: np.ndarray) -> None:
        """``at``: the queries, by number, that visit a bucket with these ids and codes."""
        q, most = self.asked, max(1, 1_000_000 // len(ids))
        for lo in range(0, len(at), most):
            some = at[lo : lo + most]
            cos = q["m"][some] @ m.T
            wide = _off(q["off"][some][:, None], off[None, :])
            keep = cos + wide >= q["least"][some][:, None]
            if len(ids) > self.k + 1:  # nothing that k others of this bucket alone beat for sure; one may be the query itself
                low = np.partition(cos - wide, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1]
                keep &= cos + wide >= low[:, None]
            qi, vi = np.nonzero(keep)
            self.held.append((q["id"][some[qi]], ids[vi], (cos - wide)[qi, vi], (cos + wide)[qi, vi]))
            self.n += len(qi)
            if self.n >= 300_000:
                self.held = [self.cut()]
                self.n = len(self.held[0][0])

    def cut(self) -> tuple[np.ndarray, ...]:
        """Each candidate once, without those that k others beat for sure."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)
        query, vec, low, high = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((-low, vec, query))
        order = order[query[order] != vec[order]]
        once = np.ones(len(order), bool)
        once[1:] = (query[order][1:] != query[order][:-1]) | (vec[order][1:] != vec[order][:-1])
        order = order[once]
        order = order[np.lexsort((-low[order], query[order]))]
        query, vec, low, high = query[order], vec[order], low[order], high[order]
        start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([start, [len(query)]]))
        kth = np.where(size >= self.k, low[np.minimum(start + self.k, start + size) - 1], np.float32(-2)) if len(query) else low
        keep = high >= np.repeat(kth, size)
        return query[keep], vec[keep], low[keep], high[keep]


def _rank(k: int):
    """Rows of a place: first its queries, with the buckets that they visit here, then what these hold, in the order of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, tables, ranker = None, [], {}, {}

        def close() -> Iterator[pa.RecordBatch]:
            for r in ranker.values():
                query, vec, low, high = r.cut()
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(low.astype(np.float64)), pa.array(high.astype(np.float64))], names=["query_id", "vec_id", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place, side = batch.column("place").to_numpy(), batch.column("side").to_numpy()
            cut = np.flatnonzero((place[1:] != place[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]), strict=True):
                if now != place[lo]:
                    yield from close()
                    now, asked, tables, ranker = place[lo], [], {}, {}
                piece = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    asked.append(piece)
                    continue
                if asked:
                    tables, asked = _asked(pa.Table.from_batches(asked)), []
                    ranker = {dims: _Ranker(q, k) for dims, q in tables.items()}
                if not tables:
                    continue
                bucket, ids = piece.column("bucket").to_numpy(), piece.column("id").to_numpy()
                for rows, m, off in _decoded(piece.column("code").to_pylist()):
                    q = tables.get(m.shape[1])
                    if q is None:
                        continue
                    keys = bucket[rows]
                    edge = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
                    for x, y in zip(edge[:-1], edge[1:], strict=True):
                        f, t = np.searchsorted(q["bucket"], keys[x], "left"), np.searchsorted(q["bucket"], keys[x], "right")
                        if t > f:
                            ranker[m.shape[1]].add(q["who"][f:t], ids[rows[x:y]], m[x:y], off[x:y])
        yield from close()

    return run


def _asked(table: pa.Table) -> dict[int, dict]:
    """Of each length of vectors: the queries' ids, codes and least scores, and which of them visit each bucket."""
    ids, least = table.column("id").to_numpy(), table.column("least").to_numpy()
    lists, raw = table.column("buckets").to_pylist(), table.column("code").to_pylist()
    out = {}
    for rows, m, off in _decoded(raw):
        bucket = np.array([b for i in rows for b in lists[i]], np.int64)
        who = np.repeat(np.arange(len(rows)), [len(lists[i]) for i in rows])
        order = np.argsort(bucket, kind="stable")
        out[m.shape[1]] = {"id": ids[rows], "m": m, "off": off, "least": least[rows].astype(np.float32), "bucket": bucket[order], "who": who[order]}
    return out


def _meet(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, and bounds of the cosine, of what may be among the k best of its place.

    Buckets are dealt out to places by a hash; large ones, counted, to several, all of
    which their queries visit. A query's code goes once to each place.
    """
    spark = index.sparkSession
    places = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = materialize(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _HOT_BUCKET).select("bucket", F.ceil(F.col("n") / _HOT_BUCKET).cast("int").alias("parts")))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    place = lambda part: F.pmod(F.xxhash64("bucket", part), F.lit(places)).cast("int")
    held = join_counted(index, hot, "bucket", "id").withColumn("place", place(F.pmod(F.xxhash64("id"), parts).cast("int")))
    asked = probes.withColumn("bucket", F.explode("buckets"))
    visits = join_counted(asked, hot, "bucket", "id").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("place", place(F.col("part")))
    # buckets of one query that lie in one place go there together
    grouped = visits.groupBy("id", "place").agg(F.collect_set("bucket").alias("buckets")).join(probes.select("id", "code", "least"), "id")
    right = grouped.select("place", F.lit(0).cast("byte").alias("side"), F.lit(0).cast("long").alias("bucket"), "id", "code", "least", "buckets")
    left = held.select("place", F.lit(1).cast("byte").alias("side"), "bucket", "id", "code", F.lit(None).cast("double").alias("least"), F.lit(None).cast("array<long>").alias("buckets"))
    both = left.unionByName(right)
    return both.repartition("place").sortWithinPartitions("place", "side", "bucket").mapInArrow(_rank(k), _MET)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        asked = {m.shape[1]: m for _, m in _vectors(batch.column("q"))}
        for rows, m in _vectors(batch.column("v")):  # of a length with q, row by row
            score[rows] = (_unit(m) * _unit(asked[m.shape[1]])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])


def _top(met: DataFrame, held: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query by the exact cosine, of those that codes can't rule out."""
    of_query = Window.partitionBy("query_id")
    once = met.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    close = once.withColumn("r", F.row_number().over(of_query.orderBy(F.desc("low")))).withColumn("kth", F.max(F.when(F.col("r") == k, F.col("low"))).over(of_query))
    pairs = close.filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("query_id", "vec_id")
    both = pairs.join(held.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").filter(F.size("v") == F.size("q"))
    scored = both.select("query_id", "vec_id", "q", "v").mapInArrow(_exact, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scored.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def _few_of_each(usable: DataFrame, k: int) -> DataFrame:
    """Without repeated rows, and of equal vectors only the k + 1 smallest ids, as no others can be returned. Only digests are grouped."""
    told = usable.withColumn("d1", F.xxhash64("v")).withColumn("d2", F.xxhash64(F.lit(_SEED), "v"))
    narrow = materialize(told.groupBy("id", "d1", "d2").agg(F.count(F.lit(1)).alias("n")))
    if narrow.filter("n > 1").limit(1).count():
        told = told.dropDuplicates(["id", "d1", "d2"])
    crowds = narrow.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select("d1", "d2")
    order = Window.partitionBy("d1", "d2").orderBy("id")
    few = narrow.join(crowds, ["d1", "d2"], "left_semi").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    last = materialize(few.groupBy("d1", F.col("d2").alias("_d2")).agg(F.max("id").alias("last")))
    if last.isEmpty():
        return told.select("id", "v")
    # two crowds of one first digest are told apart by the second
    return told.join(last, (told["d1"] == last["d1"]) & (told["d2"] == last["_d2"]), "left").filter(F.col("last").isNull() | (F.col("id") <= F.col("last"))).select("id", "v")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, choice: Choice | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``.

    ``choice`` is fitted to the vectors unless it is given. Rows without an id or a usable
    vector (null, zero, empty, or with null or non-finite components) take no part;
    vectors of other lengths than the query's aren't compared with it; rows that repeat
    an id count once, by their nearest vector; ties go to the smaller id. Queries for which the
    visited buckets hold fewer than k are searched again over everything, in blocks. An
    empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col(vector_col)
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & F.expr("exists(v, x -> x <> 0)")
    )
    held = _few_of_each(usable, k)
    queries = materialize(usable.filter(F.col("id") % every == 0).distinct())
    found, sampled, sampled_ids = choose(held, queries, k)
    choice = choice or found
    index = held.mapInArrow(_index(choice), "bucket long, id long, code binary")
    sample = spark.sparkContext.broadcast((sampled, sampled_ids))
    asked = materialize(queries.repartition("id").mapInArrow(_probe(choice, sample, k), "id long, code binary, least double, buckets array<long>"))
    best = materialize(_top(_meet(index, asked, k), held, queries, k))
    short = materialize(queries.join(best.groupBy("query_id").count().filter(F.col("count") >= k), queries["id"] == F.col("query_id"), "left_anti"))
    if short.limit(1).count():
        deal = 64
        everything = index.dropDuplicates(["id", "code"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(deal)))
        again = asked.join(short.select("id").distinct(), "id", "left_semi").withColumn("least", F.lit(-2.0)).withColumn("buckets", F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long")))
        late = _top(_meet(everything, again, k), held, queries, k)
        best = best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(late)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every fiftieth row of ``embeddings``; unusable vectors, repeats and empty tables as in ``nearest``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
