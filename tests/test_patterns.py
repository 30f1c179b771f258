"""Patterns and connecting paths against plain searches."""

import random
from itertools import combinations, permutations, product

import pytest

from graphstrata.model import HubKind, IndexConfig
from graphstrata.operators import paths, patterns
from graphstrata.operators.patterns import Hop
from graphstrata.plans.index import build
from graphstrata.sources.frames import pair_source
from tests.shapes import blocks, graph, partition, path


def some_graph(n, m, seed):
    pick = random.Random(seed)
    return {tuple(sorted(pick.sample(range(n), 2))) for _ in range(m)} | {(0, i) for i in range(1, n, 2)}


def adjacency(spark, pairs):
    both = sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})
    return spark.createDataFrame([(a, b, 1.0) for a, b in [*both, (3, 3)]], "src long, dst long, w double")


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles_and_squares(spark, seed):
    pairs = some_graph(18, 45, seed)
    has = lambda a, b: (min(a, b), max(a, b)) in pairs
    adj = adjacency(spark, pairs)
    assert sorted(map(tuple, patterns.triangles(adj).collect())) == [t for t in combinations(range(18), 3) if all(has(a, b) for a, b in combinations(t, 2))]
    squares = sum(all(has(p[i], p[(i + 1) % 4]) for i in range(4)) for q in combinations(range(18), 4) for p in ((q[0], *r) for r in permutations(q[1:])) if p[1] < p[3])
    assert sum(r["n"] for r in patterns.squares_by_corner(adj).collect()) == squares


@pytest.mark.parametrize(("listed", "ways"), [(2_000, 7), (3, 1 << 22), (3, 7)], ids=["dealt out", "hubs", "both"])
def test_squares_of_long_lists(spark, monkeypatch, listed, ways):
    adj = adjacency(spark, some_graph(18, 45, 1))
    want = sorted(map(tuple, patterns.squares_by_corner(adj).collect()))
    monkeypatch.setattr(patterns, "LISTED", listed)
    monkeypatch.setattr(patterns, "WAYS", ways)
    assert sorted(map(tuple, patterns.squares_by_corner(adj).collect())) == want


def test_no_third_nodes_are_proposed_where_no_path_leads_up(spark):
    """Parts of twenty suppliers each: wedges at parts would be ten times the pairs."""
    adj = adjacency(spark, {(1000 + p, 2000 + (p + s) % 40) for p in range(400) for s in range(20)})
    proposed = []
    assert patterns.triangles(adj, proposed).count() == 0 and sum(proposed) == 0


KINDS = {f"{k}{i}": k for k, n in (("u", 8), ("v", 6), ("w", 5)) for i in range(n)}


def plain_match(edges, pattern, kinds, distinct):
    names = sorted({v for h in pattern for v in (h.src, h.dst)})
    held = {(a, b, k) for a, b, k in edges}
    fits = lambda h, x: any((a, b, k) in held for k in ([h.kind] if h.kind else "xy") for a, b in ([(x[h.src], x[h.dst]), (x[h.dst], x[h.src])] if h.either else [(x[h.src], x[h.dst])]))
    pools = [[i for i, k in KINDS.items() if kinds.get(n, k) == k] for n in names]
    return sorted(p for p in product(*pools) if (not distinct or len(set(p)) == len(p)) and all(fits(h, dict(zip(names, p, strict=True))) for h in pattern))


@pytest.mark.parametrize(
    ("pattern", "kinds", "distinct"),
    [
        ([Hop("a", "b", "x")], {}, True),
        ([Hop("a", "b", "x"), Hop("b", "c", "y"), Hop("c", "a")], {"a": "u"}, True),
        ([Hop("a", "b", either=True), Hop("b", "c", "y"), Hop("a", "c", "x")], {}, False),
        ([Hop("a", "b", "x"), Hop("b", "c", "x"), Hop("c", "d", "y", True), Hop("d", "a", None, True)], {"a": "u", "b": "v", "c": "w"}, True),
    ],
    ids=["edge", "typed triangle", "any ways", "square"],
)
def test_patterns_against_all_bindings(spark, pattern, kinds, distinct):
    pick = random.Random(9)
    edges = sorted({(*pick.choices(sorted(KINDS), k=2), pick.choice("xy")) for _ in range(130)})
    nodes = spark.createDataFrame(list(KINDS.items()), "id string, kind string")
    found = patterns.match(nodes, spark.createDataFrame(edges + edges[:5], "src string, dst string, kind string"), pattern, kinds, distinct)
    names = sorted({v for h in pattern for v in (h.src, h.dst)})
    assert sorted(map(tuple, found.select(*names).collect())) == plain_match(edges, pattern, kinds, distinct)


def test_hubs_propose_no_more_than_their_partners_have(spark):
    """Two hubs with a thousand neighbours each, and few triangles: opening wedges at the hubs would make a million rows."""
    edges = [("h", f"a{i}", "x") for i in range(1000)] + [(f"b{i}", "h", "z") for i in range(1000)] + [(f"a{i}", f"b{i}", "y") for i in range(0, 1000, 100)]
    nodes = spark.createDataFrame([("h", "n")], "id string, kind string")
    proposed = []
    found = patterns.match(nodes, spark.createDataFrame(edges, "src string, dst string, kind string"), [Hop("p", "q", "x"), Hop("q", "r", "y"), Hop("r", "p", "z")], proposed=proposed)
    assert found.count() == 10 and sum(proposed) <= 20


def test_a_pattern_in_parts_is_refused(spark):
    nodes = spark.createDataFrame([("a", "n")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b", "x"), ("c", "d", "x")], "src string, dst string, kind string")
    with pytest.raises(ValueError, match="parts"):
        patterns.match(nodes, edges, [Hop("a", "b"), Hop("c", "d")])


def test_connecting_paths_are_shortest(spark):
    pairs = {p for p in some_graph(40, 38, 5) if p[0]} | {(50, 51)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = sorted({x for p in pairs for x in p} | {60})

    def dist(a, b):
        seen, front, d = {a}, {a}, 0
        while front and b not in front:
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
            d += 1
        return d if b in front else None

    pick = random.Random(2)
    asked = [(pick.choice(nodes), pick.choice(nodes)) for _ in range(25)] + [(60, 60), (60, 1), (50, 51), (99, 1)]
    found = {}
    rows = paths.connect(adjacency(spark, pairs), spark.createDataFrame(asked, "src long, dst long"), spark.createDataFrame([(x,) for x in nodes], "idx long")).collect()
    for r in sorted(rows, key=lambda r: r["step"]):
        found.setdefault((r["src"], r["dst"]), []).append(r["node"])
    want = {p: dist(*p) for p in set(asked) if p[0] in nodes}
    assert {p: len(x) - 1 for p, x in found.items()} == {p: d for p, d in want.items() if d is not None}
    for (a, b), way in found.items():
        assert way[0] == a and way[-1] == b and all(y in near[x] for x, y in zip(way, way[1:], strict=False))


def test_routes_are_nearly_always_shortest(spark):
    n, pairs = blocks(119, 7, 0.4, 0.06, 11)
    pairs = [(a, b) for a, b in pairs if (a - b) % 7 in (0, 1, 6)]  # blocks in a ring
    g = graph(spark, (n, pairs))
    pick = random.Random(3)
    asked = {(pick.randrange(n), pick.randrange(n)) for _ in range(60)}
    rows = paths.route(g.adj, partition(spark, [i % 7 for i in range(n)]), spark.createDataFrame(sorted(asked), "src long, dst long")).collect()
    assert {(r["src"], r["dst"]) for r in rows} == asked
    assert all(r["parts"][0] == r["src"] % 7 and r["parts"][-1] == r["dst"] % 7 and (r["routed_dist"] is None or r["routed_dist"] >= r["global_dist"]) for r in rows)
    assert sum(r["routed_dist"] == r["global_dist"] for r in rows) >= 0.9 * len(rows)


def test_a_walk_goes_beyond_the_entry_s_neighbours(spark):
    """A path of nodes in fours, each node a hub that sees one hop: one hop from the entry is the next cluster, a walk goes on."""
    names = [f"{i:04d}" for i in range(20)]
    where = spark.createDataFrame([(x, i // 4) for i, x in enumerate(names)], "id string, community int")
    index, _ = build(pair_source(spark, *path(20)), IndexConfig(hub_fraction=1.0, hubs=HubKind.DEGREE, k_hop=1), where)
    walked = [(r["step"], r["hub"], r["cost"]) for r in index.walk(["0003"], 5).orderBy("step").collect()]
    assert walked == [(0, "0003", 0), (1, "0002", 1), (2, "0004", 1), (3, "0001", 2), (4, "0005", 2), (5, "0000", 3)]
    assert [r["hub"] for r in index.walk(["0000"], 30, queue=1).orderBy("step").collect()] == names
    near = {r["id"] for r in index.similar(["0003"], 50).collect()}
    far = [r["id"] for r in index.similar_by_walk(["0003"], 50, 19).orderBy("rank").collect()]
    assert near == set(names[:8]) - {"0003"} and far == names[:3] + names[4:]
    assert index.walk(["none"], 3).count() == 0
