"""Arrivals in waves against a plain fold, and writers that meet."""

import random

import pytest

from graphstrata.model import ConflictError
from graphstrata.operators.placement import place, winners
from graphstrata.plans.index import Index, build
from graphstrata.runtime import materialize, recorded
from graphstrata.sources.frames import pair_source
from graphstrata.streaming.inserts import stream_inserts
from tests.shapes import TWO_TRIANGLES

THERE = [(f"o{i}", i % 5) for i in range(20)]


def fold(rows, fresh=5):
    known = dict(THERE)
    for name, seeds in rows:
        votes = [known[s] for s in seeds or [] if s in known]
        known[name] = min(votes, key=lambda c: (-votes.count(c), c)) if votes else fresh
        fresh += not votes
    return {name: known[name] for name, _ in rows}


def placed(spark, rows):
    new = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "id string, seeds array<string>, seq long")
    return {r["id"]: r["cluster"] for r in place(new, spark.createDataFrame(THERE, "id string, cluster int"), 5).collect()}


def some(seed):
    pick = random.Random(seed)
    name = lambda i: pick.choice("onnx") + str(pick.randrange(25 if pick.random() < 0.3 else i + 5))
    return [(f"n{i}", [name(i) for _ in range(pick.randrange(5))] if pick.random() > 0.05 else None) for i in range(70)]


@pytest.mark.parametrize(
    "rows",
    [[], [(f"n{i}", [f"n{i - 1}"] if i else ["o3"]) for i in range(90)], [(f"n{i}", [f"n{i - 1}", f"n{i - 1}"] if i else ["x"]) for i in range(40)], some(1), some(2)],
    ids=["none", "chain", "chain of a new one", "random", "random again"],
)
def test_waves_are_the_fold(spark, rows):
    assert placed(spark, rows) == fold(rows)


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    path = str(tmp_path / "index")
    build(pair_source(spark, *TWO_TRIANGLES), path=path)
    one, other = Index.open(spark, path), Index.open(spark, path)
    one.insert_node("a", ["0000"])
    with pytest.raises(ConflictError):
        other.insert_node("b", ["0005"])
    now = Index.open(spark, path)
    assert now.cluster_of("a") == 0 and now.cluster_of("b") is None
    (tmp_path / "index" / "CURRENT").unlink()  # only a hint
    (tmp_path / "index" / ".CURRENT.crc").unlink(missing_ok=True)
    assert Index.open(spark, path).cluster_of("a") == 0
    build(pair_source(spark, *TWO_TRIANGLES), path=path)
    assert Index.open(spark, path).cluster_of("a") is None


def test_a_stream_keeps_order_and_the_first_of_an_id(spark, tmp_path):
    path, arrivals = str(tmp_path / "index"), tmp_path / "arrivals"
    build(pair_source(spark, *TWO_TRIANGLES), path=path)
    arrivals.mkdir()
    rows = ["a,0000", "b,a", "a,0005", "c,b", "d,none", "e,d"]
    (arrivals / "1.csv").write_text("\n".join(rows))
    lines = spark.readStream.schema("id string, seed string").csv(str(arrivals)).selectExpr("id", "array(seed) AS seeds")
    stream_inserts(spark, path, lines, str(tmp_path / "checkpoint")).awaitTermination()
    index = Index.open(spark, path)
    found = {r["id"]: r["cluster"] for r in index.assignments.filter("length(id) = 1").collect()}
    assert found == {"a": 0, "b": 0, "c": 0, "d": 2, "e": 2}


def test_votes_are_hashed_and_not_sorted(spark):
    rows = [(n, c, k) for n in range(40) for c, k in [(n % 7, 2), (3, 1), (2**31 - 1, 3 - n % 3), (n % 5, 1), (0, n % 2)]]
    votes = materialize(spark.createDataFrame(rows, "n long, cluster int, k long"))
    sums = {}
    for n, c, k in rows:
        sums.setdefault(n, {}).setdefault(c, 0)
        sums[n][c] += k
    found = winners(votes)
    assert found.schema["cluster"].dataType == votes.schema["cluster"].dataType
    assert {r["n"]: r["cluster"] for r in found.collect()} == {n: min(s, key=lambda c: (-s[c], c)) for n, s in sums.items()}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_arrivals_that_wait_for_none_are_written_thrice(spark):
    n = 300
    rows = [(f"n{i:03}", [f"o{i % 20}"] if i % 3 else ["x"]) for i in range(n)]
    with recorded() as folders:
        assert placed(spark, rows) == fold(rows)
    # numbered, with their seeds' clusters, and placed; those without a vote are numbered once more, and names are few
    assert sum(spark.read.parquet(f).count() for f in folders) <= 3 * n + 2 * len(THERE) + 1
