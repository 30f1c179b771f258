"""A Merkle manifest of the documents: a tree for each source, and one above their roots.

Bottom up, each level is a table of its own, written to the shared folder: nodes are
grouped by their parent's place, three at most, and a parent keeps its children's digests
beside its own. Top down, each level's nodes are joined to their parents: a node puts its
own siblings before what its parent was given, which is the rest of its proof. A source of
any size is spread by the places of its nodes, and no group is larger than a run.

Places come from one range-partitioned numbering of all leaves, by source, id and digest:
rows that agree in all of these are rows of their own in neighbouring places, and as their
digests are equal it doesn't matter which comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.skew import join_counted
from graphstrata.operators.indexing import dense_index
from graphstrata.runtime import materialize

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "cast(array() AS array<struct<left: string, right: string>>)"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields)), 256)


@dataclass(frozen=True)
class Tree:
    """levels[k]: (tree, pos, n, digest, parts) of each tree that is higher than k. n: how many nodes the tree has at this level; parts: the children's digests, null for leaves."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(tree, digest) of each tree's root."""
        every = [level.filter("n = 1").select("tree", "digest") for level in self.levels]
        out = every[0]
        for x in every[1:]:
            out = out.unionByName(x)
        return out


def build_tree(leaves: DataFrame) -> Tree:
    """``leaves``: (tree, pos, n, digest), pos from 0. Each level is written before the next is made of it."""
    levels = [leaves.select("tree", "pos", "n", "digest", F.lit(None).cast("array<string>").alias("parts"))]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = levels[-1].filter("n > 1")
        runs = below.groupBy("tree", "n", F.expr(f"pos div {ARITY}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        parts = runs.select("tree", F.col("up").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.col("run.digest").alias("parts"))
        levels.append(materialize(parts.select("tree", "pos", "n", F.sha2(F.array_join("parts", ""), 256).alias("digest"), "parts")))
        most = -(-most // ARITY)
    return Tree(levels)


def push_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(tree, pos, path, top) of every leaf, ``top`` being its tree's root.

    ``above``: (tree, path), what each tree's root was given. path: for each level from the
    leaf up the siblings' digests, joined, to the left and to the right.
    """
    inherited: DataFrame | None = None
    for k in reversed(range(len(tree.levels))):
        level = tree.levels[k]
        found = level.filter("n = 1").join(above, "tree").select("tree", "pos", "parts", "path", F.col("digest").alias("top"))
        if inherited is not None:
            up = inherited.select("tree", F.col("pos").alias("up"), F.col("parts").alias("run"), F.col("path").alias("rest"), "top")
            child = F.expr(f"cast(pos % {ARITY} AS int)")
            sides = F.struct(F.array_join(F.slice("run", F.lit(1), child), "").alias("left"), F.array_join(F.slice("run", child + 2, F.lit(ARITY)), "").alias("right"))
            below = level.filter("n > 1").withColumn("up", F.expr(f"pos div {ARITY}")).join(up, ["tree", "up"])
            found = found.unionByName(below.select("tree", "pos", "parts", F.concat(F.array(sides), F.col("rest")).alias("path"), "top"))
        inherited = materialize(found) if k else found
    return inherited.select("tree", "pos", "path", "top")


def proof(path: Column) -> Column:
    """All siblings of a path, level by level."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def manifest(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """Columns of ``leaves`` (source, doc_id, leaf and others) with subroot and path, and the root, null without leaves.

    Sources stand in the order of their bytes, null first. ``leaves`` is read more than once.
    """
    numbered = dense_index(leaves, "source", "doc_id", "leaf", name="_place").withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sources = dense_index(numbered.groupBy("_key").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n")), "_first", name="tree")
    placed = join_counted(numbered, sources.select("_key", "_first", "n", "tree"), "_key", "_place", "inner")
    placed = materialize(placed.withColumn("pos", F.col("_place") - F.col("_first")).drop("_key", "_first", "_place"))
    trees = build_tree(placed.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    count = sources.count()
    subroots = materialize(trees.tops().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "digest"))
    top = build_tree(subroots)
    root = top.tops().first()
    to_sources = push_paths(top, placed.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.expr(_NO_PATH).alias("path")))
    paths = push_paths(trees, materialize(to_sources.select(F.col("pos").alias("tree"), "path")))
    out = placed.join(paths, ["tree", "pos"]).withColumnRenamed("top", "subroot").drop("tree", "pos", "n")
    return out, root and root["digest"]


def tamper(c: Column) -> Column:
    """Text without its line ends; null stays."""
    return F.replace(c.cast("string"), F.lit("\n"), F.lit(""))


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of documents as they are; folded_root and verified after tampering with every second one.

    Nulls are fields of their own. A null id stands first in its source and isn't tampered
    with; rows that repeat are leaves each; empty and long texts are hashed whole; an empty
    table has no rows. Columns beyond FIELDS are left out.
    """
    columns = [F.col(c) for c in FIELDS]
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    other = F.when(touched, leaf(*columns[:-1], tamper(columns[-1])))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*columns).alias("leaf"), other.alias("other")))
    out, root = manifest(rows)
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return verified_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# ---------------------------------------------------------------- the same in SQL

_LEVELS = 24  # trees of up to 3 ** 24 leaves
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in (*FIELDS[:-1], text)) + ")"


def _climb(name: str, first: str) -> str:
    """Levels of trees from a table (tree, pos, n, digest), and the rows' way up; trees of one node stay as they are."""
    out = f"{name}0 AS MATERIALIZED ({first}), {name}r0 AS MATERIALIZED (SELECT tree, pos AS leaf_pos, pos, n, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS path FROM {name}0)"
    for k in range(_LEVELS):
        out += f""",
{name}g{k} AS MATERIALIZED (SELECT tree, n, pos // {ARITY} AS up, list(digest ORDER BY pos) AS parts FROM {name}{k} WHERE n > 1 GROUP BY ALL),
{name}{k + 1} AS MATERIALIZED (SELECT tree, up AS pos, (n + {ARITY - 1}) // {ARITY} AS n, sha256(array_to_string(parts, '')) AS digest FROM {name}g{k} UNION ALL SELECT * FROM {name}{k} WHERE n = 1),
{name}r{k + 1} AS MATERIALIZED (SELECT tree, leaf_pos, up AS pos, (n + {ARITY - 1}) // {ARITY} AS n,
  list_append(path, {{'l': array_to_string(parts[1:pos % {ARITY}], ''), 'r': array_to_string(parts[pos % {ARITY} + 2:], '')}}) AS path
  FROM {name}r{k} JOIN (SELECT tree, up, parts FROM {name}g{k}) g USING (tree) WHERE g.up = pos // {ARITY} AND n > 1 UNION ALL SELECT * FROM {name}r{k} WHERE n = 1)"""
    return out


_CRC_ODD = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b:
  list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS BIGINT)) % 2"""

ORACLE = f"""
WITH rows AS MATERIALIZED (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC_ODD} = 1 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS other FROM documents),
placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM rows),
{_climb("a", "SELECT tree, pos, n, leaf AS digest FROM placed")},
{_climb("b", f"SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, digest FROM a{_LEVELS}")},
whole AS (SELECT p.*, s.digest AS subroot, t.digest AS root, list_concat(x.path, y.path) AS path
  FROM placed p JOIN ar{_LEVELS} x ON x.tree = p.tree AND x.leaf_pos = p.pos JOIN a{_LEVELS} s ON s.tree = p.tree JOIN br{_LEVELS} y ON y.leaf_pos = p.tree JOIN b{_LEVELS} t ON true),
folded AS (SELECT *, list_reduce(path, lambda d, p: {{'l': sha256(p.l || d.l || p.r), 'r': ''}}, {{'l': coalesce(other, leaf), 'r': ''}}).l AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
