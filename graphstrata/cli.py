"""Command line: build an index from SQL dumps and ask it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata import version
from graphstrata.plans.index import Index, build
from graphstrata.sources import sqldump

_DRIFT_ROWS = 50


def _build(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    source = sqldump.from_path(spark, args.from_sql)
    _, stats = build(source, path=args.index)
    return [
        f"{source.table_count()} tables, {source.fk_count()} foreign keys, {source.proc_pair_count()} routine pairs, {source.edge_count()} edges",
        f"{stats.nodes} nodes, {stats.clusters} clusters, {stats.regions} regions, {stats.hubs} hubs",
    ]


def _names(found: DataFrame) -> list[str]:
    return [r["label"] for r in found.orderBy("rank").select("label").collect()]


def _similar(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    index = Index.open(spark, args.index)
    if index.id_of_label(args.name) is None:
        return [f"{args.name} is not in the index"]
    return _names(index.similar_by_label([args.name], args.limit)) or [f"{args.name} has no neighbours"]


def _same_cluster(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    return _names(Index.open(spark, args.index).same_cluster_by_label([args.name])) or [f"{args.name} is not in the index"]


def _info(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    return [f"{k}: {v}" for k, v in Index.open(spark, args.index).stats().items()]


def _clusters(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    index = Index.open(spark, args.index)
    chosen = F.broadcast(index.clusters.filter(F.col("size") >= args.min_size).orderBy("cluster").limit(args.limit))  # what is shown
    named = index.assignments.join(chosen.select("cluster"), "cluster", "left_semi").groupBy("cluster").agg(F.array_sort(F.collect_list(F.coalesce("label", "id"))).alias("names"))
    rows = chosen.join(named, "cluster").orderBy("cluster").collect()
    return [f"{r['cluster']}: {r['size']} nodes, {r['hub_count']} hubs: {', '.join(r['names'])}" for r in rows]


def _drift(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    frame = Index.open(spark, args.index).drift_frame()
    top = frame.filter("delta_inserts > 0").orderBy(F.desc("delta_inserts"), "cluster").limit(_DRIFT_ROWS).collect()
    total = frame.agg(F.coalesce(F.sum("delta_inserts"), F.lit(0))).first()[0]
    return [f"{r['cluster']}: {r['delta_inserts']} inserts" for r in top] + [f"total: {total}"]


def _tables(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    names = Index.open(spark, args.index).labels.select("label")
    if args.grep:
        names = names.filter(F.col("label").contains(args.grep))
    return [r["label"] for r in names.orderBy("label").limit(args.limit).collect()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphstrata")
    top.add_argument("--version", action="version", version=version())
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, index: str = "--index") -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.add_argument(index, dest="index", required=True)
        p.set_defaults(run=run)
        return p

    verb("build", _build, "--to").add_argument("--from-sql", required=True)
    p = verb("similar", _similar)
    p.add_argument("name")
    p.add_argument("--limit", type=int, default=10)
    verb("same-cluster", _same_cluster).add_argument("name")
    verb("info", _info)
    p = verb("clusters", _clusters)
    p.add_argument("--min-size", type=int, default=1)
    p.add_argument("--limit", type=int, default=100)
    verb("drift", _drift)
    p = verb("tables", _tables)
    p.add_argument("--grep")
    p.add_argument("--limit", type=int, default=200)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphstrata").getOrCreate()
    for line in args.run(spark, args):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
