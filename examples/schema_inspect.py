"""Clusters of a SQL dump's tables, and the nearest tables of a few: python examples/schema_inspect.py DUMP.sql"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphstrata.plans.index import build
from graphstrata.sources import sqldump

spark = SparkSession.builder.master("local[*]").appName("schema").getOrCreate()
index, stats = build(sqldump.from_path(spark, sys.argv[1]))
print(stats)
index.assignments.groupBy("cluster").agg(F.count("*").alias("tables"), F.array_sort(F.collect_list("label")).alias("names")).orderBy("cluster").show(truncate=120)
seeds = [r["label"] for r in index.labels.orderBy("label").limit(5).collect()]
index.similar_by_label(seeds, 5).orderBy("seed", "rank").show(truncate=False)
