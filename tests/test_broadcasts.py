"""What is broadcast goes by counted rows, not by the bytes of compressed files."""

from pyspark.sql import functions as F

from graphstrata.operators import community, paths
from graphstrata.operators.joins import join_lookup, large, small
from graphstrata.runtime import materialize

N = 150_000


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_levels_are_merged(spark):
    pairs = spark.range(N).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    adj = materialize(pairs.selectExpr("a AS src", "b AS dst", "1.0D AS w").union(pairs.selectExpr("b", "a", "1.0D")))
    alone = community._kept(spark.range(2 * N).selectExpr("id AS idx", "id AS community"))
    state = community._kept(community._state(adj, alone))
    assert "Broadcast" not in planned(community._round(adj, state, 2.0 * N, 1))
    assert "Broadcast" not in planned(community.coarsen(adj, state))


def test_lookups_counted_as_long_are_merged(spark):
    long, short = materialize(spark.range(N).selectExpr("id", "id % 7 AS v")), materialize(spark.range(9).selectExpr("id", "id AS u"))
    assert "Broadcast" not in planned(long.join(small(long.withColumnRenamed("v", "u")), "id"))
    assert "Broadcast" not in planned(long.join(large(long.withColumnRenamed("v", "u")), "id"))
    assert "BroadcastHashJoin" in planned(long.join(small(short), "id"))
    assert "Broadcast" not in planned(join_lookup(long, long.withColumnRenamed("v", "u"), "id", "v"))
    assert join_lookup(long, long.withColumnRenamed("v", "u"), "id", "v").filter("u = v").count() == N


def test_long_pendants_are_merged(spark, monkeypatch):
    near = materialize(spark.range(N).selectExpr("id AS src", "id + 1 AS dst"))
    hanging = materialize(spark.range(N).selectExpr("id * 3 AS node", "id * 3 + 1 AS up"))
    monkeypatch.setattr(paths, "materialize", lambda df: df)
    rest = paths.without(near, hanging)
    assert "Broadcast" not in planned(rest)
    assert rest.count() == N // 3
