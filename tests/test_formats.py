"""Files as data sources, and long documents in blocks against whole ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphstrata.model import DanglingEdgeError, GmlParseError
from graphstrata.sources import formats, gml, gml_blocks, gml_text


def document(seed, nodes=60, edges=90):
    pick = random.Random(seed)
    blank = lambda: pick.choice([" ", "\n", "\t", "  \n", ' # a ] "note" [\n'])
    label = lambda: pick.choice(['"x"', '"[ node ]"', '"# no note"', '"two\nlines"', '"é]"', "-1.5e3", "7"])
    out, ids = [f'Creator "]" Version 1{blank()}other [ node [ id 7 ] ]{blank()}graph{blank()}[ directed 0{blank()}'], []
    for _ in range(nodes):
        ids.append(pick.randrange(1000) if pick.random() > 0.2 or not ids else pick.choice(ids))
        out.append(f"node{blank()}[{blank()}id {ids[-1]}{blank()}label {label()} graphics [ x 1 y [ z 2 ] ]{blank()}]{blank()}")
    for _ in range(edges):
        out.append(f"edge [ source {pick.choice(ids)}{blank()}target {pick.choice(ids)} value {label()} ]{blank()}")
    for k in range(edges // 3):  # between nodes, in place of what stood there
        out.insert(pick.randrange(3, len(out)), f"edge [ source {ids[0]} target {ids[0]} ]{blank()}" if k % 2 else f"comment{blank()}[ {blank()}node [ id 5 ] ]{blank()}")
    return "".join(out) + f"]{blank()}after [ node [ id 8 ] ]{blank()}graph [ node [ id 9 ] ]"


def found(source):
    nodes = sorted((r["seq"]["seq"], r["id"]) for r in source.nodes().collect())
    edges = sorted((r["seq"]["seq"], r["src"], r["dst"]) for r in source.edges().collect())
    return [n[1:] for n in nodes], [e[1:] for e in edges]


@pytest.mark.parametrize("seed,block", [(1, 64), (2, 700), (3, 1500)])
def test_blocks_tell_what_the_whole_does(spark, tmp_path, seed, block):
    path = tmp_path / "long.gml"
    path.write_text(document(seed))
    want = found(gml.from_text(spark, document(seed)))
    assert len(want[0]) == 60 and found(gml.from_path(spark, str(path), block_bytes=block)) == want


def test_every_cut_of_a_document(tmp_path):
    """All block sizes, without Spark: the blocks' rows are those of one block."""
    text = document(4, 6, 5)
    path = tmp_path / "long.gml"
    path.write_text(text)
    data = path.read_bytes()
    whole = None
    for size in [len(data), *range(3, 400, 7)]:
        state, depth, line, rows, last = gml_blocks.PLAIN, 0, 1, [], None
        graph = data.index(b"graph")
        for start in range(0, len(data), size):
            cut = {"file": str(path), "start": start, "end": min(start + size, len(data)), "size": len(data), "state": state, "depth": depth, "line": line, "graph": graph}
            cut["inside"] = last == graph
            rows += gml_blocks.read(cut)
            keys = gml_blocks._top_keys(cut)
            last = keys[-1][0] if keys else last
            part = data[start : start + size]
            state, deeper, _ = gml_blocks.passage(part, state)
            depth, line = depth + deeper, line + part.count(b"\n")
        whole = whole or rows
        assert rows == whole, size
    assert [r[1] for r in whole].count("node") == 6 and [r[1] for r in whole].count("edge") == 5
    assert {r[6] for r in whole} <= set(range(1, text.count("\n") + 2))


@pytest.mark.parametrize(
    "text, error",
    [
        ("graph [ node [ id 1 ] edge [ source 1 target 2 ] node [ id 2 ] ]", DanglingEdgeError),
        ("graph [ node [ id 1 ] node [ label 3 ] node [ id 4 ] node [ id 5 ] ]", GmlParseError),
        ("graph [ node [ id 1 ] ] ] node [ id 1 ] node [ id 2 ]", GmlParseError),
        ("graph [ node [ id 1 ] node [ id 1 ] node [ id 2 ]   ", GmlParseError),
        ('graph [ node [ id 1 ] node [ label "a ] node [ id 2 ] ]', GmlParseError),
        ("nothing [ node [ id 1 ] node [ id 1 ] node [ id 2 ] ]", GmlParseError),
        ("% graph [ node [ id 1 ] node [ id 1 ] ]", GmlParseError),
        ("graph 5 other [ node [ id 1 ] node [ id 1 ] ]", GmlParseError),
        ("graph [ node [ id 1 ] $ node [ id 1 ] node [ id 2 ] ]", GmlParseError),
    ],
)
def test_errors_in_blocks(spark, tmp_path, text, error):
    path = tmp_path / "bad.gml"
    path.write_text(text)
    for block in (11, 1 << 20):
        with pytest.raises(error):
            gml.from_path(spark, str(path), block_bytes=block)


def test_a_long_document_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "long.gml"
    path.write_text("graph [\n" + "".join(f"node [ id {i} ]\n" for i in range(3000)) + "".join(f"edge [ source {i} target 0 ]\n" for i in range(3000)) + "]")
    cuts = gml_blocks.cuts(spark, str(path), 10_000)
    formats.register(spark)
    read = spark.read.format("gml").option("cuts", json.dumps(cuts)).load(str(path))
    sizes = {r["p"]: r["count"] for r in read.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert len(sizes) >= 9 and sum(sizes.values()) == 6000 and max(sizes.values()) < 1000


def test_formats_of_folders(spark, tmp_path):
    for name, text in (("a", "graph [ node [ id 1 ] ]"), ("b", "graph [ node [ id 1 ] node [ id 2 ] edge [ source 1 target 2 ] ]"), ("_hidden", "no")):
        (tmp_path / f"{name}.gml").write_text(text)
    formats.register(spark)
    rows = spark.read.format("gml").load(str(tmp_path)).groupBy("fact").count().collect()
    assert {r["fact"]: r["count"] for r in rows} == {"node": 3, "edge": 1}
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "one.sql").write_text("CREATE TABLE `t` (\n a int\n);\nCREATE TABLE `u` (\n FOREIGN KEY (a) REFERENCES t (a)\n);\n")
    assert [r["fact"] for r in spark.read.format("sqldump").load(str(tmp_path / "dump")).orderBy("line").collect()] == ["table", "table", "fk"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("gml").load(str(tmp_path / "none")).count() == 0


def test_rows_carry_errors():
    assert gml_text.rows("f", "graph [ node [ ] ]")[-1][1] == "error"
