import pytest

from graphstrata.model import DanglingEdgeError, EdgeListParseError, GmlParseError
from graphstrata.operators.graph import Graph
from graphstrata.sources import edgelist, gml, sqldump

GML = 'Creator "someone"\ngraph [ directed 0\n # a comment\n node [ id 1 label "x" ]\n node [ id 2 ]\n edge [ source 1 target 2 weight 0.5 ]\n]\n'

SCHEMA = """
USE `shop`;
CREATE TABLE `customer` (
  `id` int NOT NULL,
  PRIMARY KEY (`id`)
) ENGINE=InnoDB;
CREATE TABLE `address` (
  `id` int,
  `customer_id` int,
  CONSTRAINT `a` FOREIGN KEY (`customer_id`) REFERENCES `customer` (`id`)
);
CREATE TABLE `orders` (
  `parent` int,
  CONSTRAINT `p` FOREIGN KEY (`parent`) REFERENCES `orders` (`id`),
  CONSTRAINT `c` FOREIGN KEY (`customer_id`) REFERENCES `customer` (`id`)
);
CREATE TABLE `order_item` (
  `order_id` int,
  CONSTRAINT `o` FOREIGN KEY (`order_id`) REFERENCES `orders` (`id`)
);
"""


def test_edge_list(spark):
    s = edgelist.from_text(spark, "# c\n10\t20\n20 10\n\n20 30\n30 10\n")
    g = Graph.from_frames(s.nodes(), s.edges())
    assert (s.node_count(), s.edge_count()) == (3, 3)
    assert [g.degree(i) for i in range(3)] == [2, 2, 2]
    assert sorted(r["label"] for r in edgelist.from_text(spark, "7 99").nodes().collect()) == ["7", "99"]
    assert edgelist.from_text(spark, "5 5\n5 6").edge_count() == 2
    assert edgelist.from_text(spark, f"{2**64 - 1} 1").node_count() == 2


@pytest.mark.parametrize(("text", "line"), [("1 2\nnot numbers\n", 2), ("1 2 3\n", 1), ("1 2\n-1 2", 2), (f"{2**64} 1", 1)])
def test_bad_edge_list(spark, tmp_path, text, line):
    with pytest.raises(EdgeListParseError) as e:
        edgelist.from_text(spark, text)
    assert e.value.line == line
    (tmp_path / "e.txt").write_text(text)
    with pytest.raises(EdgeListParseError) as e:
        edgelist.from_path(spark, str(tmp_path / "e.txt"))
    assert e.value.line == line


def test_gml(spark):
    s = gml.from_text(spark, GML, "person", "knows")
    assert (s.node_count(), s.edge_count()) == (2, 1)
    assert {r["kind"] for r in s.nodes().collect()} == {"person"}
    assert gml.from_text(spark, "graph [ ]").node_count() == 0


def test_gml_id_declared_twice_is_a_second_node(spark):
    s = gml.from_text(spark, "graph [ node [ id 1 ] node [ id 1 ] node [ id 2 ] edge [ source 1 target 2 ] ]")
    assert s.node_count() == 3
    assert [(r["src"], r["dst"]) for r in s.edges().collect()] == [("1#2", "2")]


@pytest.mark.parametrize(
    ("text", "error", "match"),
    [
        ("graph [ node [ label 3 ] ]", GmlParseError, "id"),
        ("graph [ node [ id 1 ] edge [ source 1 target 99 ] ]", DanglingEdgeError, "99"),
        ('graph [ node [ id 1 label "open ] ]', GmlParseError, "unterminated"),
        ("Creator 1", GmlParseError, "no graph"),
        ("graph [ node 3 ]", GmlParseError, "not a list"),
        ("graph [ node [ id 1 ]", GmlParseError, "end of file"),
    ],
)
def test_bad_gml(spark, text, error, match):
    with pytest.raises(error, match=match):
        gml.from_text(spark, text)


def test_schema(spark):
    s = sqldump.from_text(spark, SCHEMA)
    assert (s.table_count(), s.fk_count()) == (4, 4)
    assert s.tables_named() == ["shop.address", "shop.customer", "shop.order_item", "shop.orders"]
    assert Graph.from_frames(s.nodes(), s.edges()).self_loop(2) == 1


@pytest.mark.parametrize(
    ("text", "tables", "keys", "pairs", "edges"),
    [
        ("", 0, 0, 0, 0),
        ("-- c\n/*!40101 SET x */;\nCREATE TABLE `a` (\n `i` int\n);", 1, 0, 0, 0),
        ("CREATE TABLE `a` (\n `x` int,\n FOREIGN KEY (`x`) REFERENCES `gone` (`i`)\n);", 1, 0, 0, 0),
        ("CREATE TABLE `a` (`i` int);\nCREATE TABLE `b` (`j` int);\nALTER TABLE `a` ADD CONSTRAINT `k` FOREIGN KEY (`i`) REFERENCES `b` (`j`);", 2, 1, 0, 1),
        ("USE `x`;\nCREATE TABLE `a` (`i` int);\nCREATE TABLE `b` (`i` int);\nUSE `y`;\nCREATE TABLE `a` (`i` int);\nCREATE TABLE `b` (`i` int);", 4, 0, 0, 0),
        ("CREATE TABLE `a` (`i` int);\nCREATE TABLE `b` (`i` int);\nDELIMITER ;;\nCREATE PROCEDURE p() BEGIN\nCREATE TABLE `t` (`i` int);\nEND ;;\nDELIMITER ;", 2, 0, 0, 0),
        ("CREATE TABLE `a` (`i` int);\nCREATE TABLE `b` (`i` int);\nDELIMITER ;;\nSELECT * FROM a JOIN b ON 1;\nDELIMITER ;", 2, 0, 1, 1),
        ("CREATE TABLE `a` (`i` int);\nCREATE TABLE `b` (`i` int);\n" + "".join(f"DELIMITER ;;\n{q}\nDELIMITER ;\n" for q in ("SELECT * FROM a JOIN b", "UPDATE a SET x = (SELECT 1 FROM b)", "DELETE FROM a WHERE x IN (SELECT y FROM b)")), 2, 0, 1, 3),
        ("CREATE TABLE `a` (`i` int);\nDELIMITER ;;\nSELECT * FROM a JOIN gone;\nDELIMITER ;", 1, 0, 0, 0),
    ],
)
def test_dumps(spark, text, tables, keys, pairs, edges):
    s = sqldump.from_text(spark, text)
    assert (s.table_count(), s.fk_count(), s.proc_pair_count(), s.edge_count()) == (tables, keys, pairs, edges)


def test_dumps_are_read_as_their_writers_mean_them(spark):
    text = """USE `my-db`;
CREATE TABLE `a` (
  `x` int REFERENCES `b` (`id`),
  `y` varchar(9) DEFAULT ' #1', CONSTRAINT `c` FOREIGN KEY (`y`) REFERENCES `b` (`id`)
) ENGINE=InnoDB;
CREATE TABLE `b` (`id` int) ENGINE=InnoDB;
  DELIMITER ;;
CREATE PROCEDURE `p`()
BEGIN
USE other;
SELECT * FROM b JOIN `a` ON 1;
END ;;
  DELIMITER ;
CREATE TABLE `b` (`id` int);
ALTER TABLE `b` ADD CONSTRAINT `k` FOREIGN KEY (`id`) REFERENCES `my-db`.`a` (`x`);
"""
    s = sqldump.from_text(spark, text)
    assert s.tables_named() == ["my-db.a", "my-db.b", "other.b"]
    assert sorted((r["a"], r["b"]) for r in s.foreign_keys().collect()) == [("my-db.a", "my-db.b"), ("other.b", "my-db.a")]
    assert sorted(r["a"] for r in s.facts.filter("fact = 'mention'").collect()) == ["other.a", "other.b"]
