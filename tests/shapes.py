"""Small graphs and partitions for tests."""

from __future__ import annotations

from graphstrata.operators.graph import Graph
from graphstrata.sources.frames import pair_source

TWO_TRIANGLES = (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)])
BRIDGED = (6, [*TWO_TRIANGLES[1], (0, 3)])
DIAMOND = (4, [(0, 1), (1, 2), (2, 3), (0, 2)])


def triangle_chain(n, bridges=True):
    inner = [p for t in range(n) for p in ((3 * t, 3 * t + 1), (3 * t + 1, 3 * t + 2), (3 * t, 3 * t + 2))]
    return 3 * n, inner + [(3 * t - 3, 3 * t) for t in range(1, n)] * bridges


def star(leaves):
    return leaves + 1, [(0, i) for i in range(1, leaves + 1)]


def path(n):
    return n, [(i, i + 1) for i in range(n - 1)]


def two_cliques(c):
    cliques = [(b + i, b + j) for b in (0, c) for i in range(c) for j in range(i + 1, c)]
    return 2 * c + 1, [*cliques, (0, 2 * c), (2 * c, c)]


def graph(spark, shape):
    source = pair_source(spark, *shape)
    return Graph.from_frames(source.nodes(), source.edges())


def partition(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "idx long, community int")


def labels(frame):
    return [r["community"] for r in frame.orderBy("idx").collect()]


class Xorshift:
    def __init__(self, seed):
        self.x = seed or 1

    def next(self):
        m = (1 << 64) - 1
        self.x ^= self.x << 13 & m
        self.x ^= self.x >> 7
        self.x ^= self.x << 17 & m
        return self.x


def blocks(n, k, inside, across, seed):
    """A stochastic block model: node i in block i mod k."""
    rng = Xorshift(seed)
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            if (rng.next() >> 11) / (1 << 53) < (inside if i % k == j % k else across):
                pairs.append((i, j))
    return n, pairs
