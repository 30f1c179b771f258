"""Build an index over a small graph and ask it for neighbours."""

from pyspark.sql import SparkSession

from graphstrata.plans.index import build
from graphstrata.sources.frames import pair_source

spark = SparkSession.builder.master("local[*]").appName("quickstart").getOrCreate()
index, stats = build(pair_source(spark, 6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3)]))
print(stats)
index.same_cluster(["0000"]).show()
index.similar(["0000", "0004"], 5).orderBy("seed", "rank").show()
index.similar_stats(["0000", "0004"], 5).show()
