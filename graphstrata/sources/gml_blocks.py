"""Long GML documents, read in blocks by many tasks.

Whether a bracket counts depends on whether it stands in a string or a comment, and that
on all before it. So each block is first read on its own for every state that it may begin
in: what state it then ends in, by how much the depth changes, and how low it gets. One
small row a block is put together in the order of the file, as a list of splits is, and
tells where each block begins in truth. Then blocks are parsed side by side: a block has
the nodes and edges whose keys begin in it, from its first blank on to the next one's.
Names of ids that are declared again, and edges whose ends are not yet declared, are
told by joins. Bytes above 127 count as letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphstrata.model import DanglingEdgeError, GmlParseError
from graphstrata.operators.joins import join_lookup
from graphstrata.sources import formats
from graphstrata.sources.gml_text import Reader, failed, told

PLAIN, TEXT, NOTE = range(3)
_STATES = (PLAIN, TEXT, NOTE)
_QUIET = re.compile(rb'"[^"]*"?|#[^\n]*')
_BLANK = re.compile(rb"\s")
_MARK = re.compile(r'"[^"]*"?|#[^\n]*|(?P<open>\[)|(?P<close>\])|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_]\w*)')
_LETTERS = bytes(range(128)) + b"\xe9" * 128
_PIECE = 1 << 20


def passage(data: bytes, state: int) -> tuple[int, int, int]:
    """(state, depth, low) after a block that is entered in a state: depth and its lowest, from 0 at its begin."""
    at = 0
    if state != PLAIN:
        at = data.find(b'"' if state == TEXT else b"\n") + 1
        if not at:
            return state, 0, 0
    last = None
    for last in _QUIET.finditer(data, at):
        pass
    end = PLAIN
    if last and last.end() == len(data):
        if last[0].startswith(b"#"):
            end = NOTE
        elif len(last[0]) == 1 or not last[0].endswith(b'"'):
            end = TEXT
    left = np.frombuffer(_QUIET.sub(b" ", data[at:]), np.uint8)
    depths = np.cumsum((left == ord("[")).astype(np.int64) - (left == ord("]")))
    return (end, int(depths[-1]), min(0, int(depths.min()))) if len(depths) else (end, 0, 0)


class _Tape:
    """A file from a place on, a character for each byte, of which more is read when asked for."""

    def __init__(self, path: str, at: int, size: int):
        system, inside = formats.opened(path)
        self.file, self.piece, self.text = system.open_input_file(inside), size, ""
        self.file.seek(at)
        self.grow()

    def grow(self) -> bool:
        data = self.file.read(self.piece)
        self.text += data.translate(_LETTERS).decode("latin-1")
        self.piece = max(_PIECE, len(self.text))
        return bool(data)


def _read_bytes(path: str, start: int, end: int) -> bytes:
    system, inside = formats.opened(path)
    with system.open_input_file(inside) as f:
        return f.read_at(end - start, start)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            data = _read_bytes(row["file"], row["start"], row["end"])
            ways = [passage(data, s) for s in _STATES]
            out.append({**row, "ends": [w[0] for w in ways], "depths": [w[1] for w in ways], "lows": [w[2] for w in ways], "lines": data.count(b"\n")})
        kinds = [("file", pa.string()), *((n, pa.int64()) for n in ("start", "end", "size")), *((n, pa.list_(pa.int64())) for n in ("ends", "depths", "lows")), ("lines", pa.int64())]
        yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))


def _top_keys(cut: dict) -> list[tuple[int, str]]:
    """(place, key) of the keys outside of all lists that begin in a block."""
    tape = _Tape(cut["file"], cut["start"], cut["end"] - cut["start"] + _PIECE)
    begin, limit = _bounds(cut)
    return [(at, key) for at, key, depth, _ in _keys(tape, cut["state"], cut["depth"], begin, limit) if not depth]


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            every = _top_keys(row)
            keys = [k for k in every if k[1]]
            first = next((at for at, key in keys if key == "graph"), None)
            out.append({"file": row["file"], "start": row["start"], "graph": first, "last": keys[-1][0] if keys else None, "bad": len(every) - len(keys)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("start", pa.int64()), ("graph", pa.int64()), ("last", pa.int64()), ("bad", pa.int64())]))


def cuts(spark: SparkSession, path: str, block_bytes: int) -> list[dict]:
    """The blocks of all files under a path that are longer than a block: where each begins, in what state, depth and line, and where its graph's key stands."""
    blocks = []
    for file in formats.files(path):
        system, inside = formats.opened(file)
        size = system.get_file_info(inside).size
        if size > block_bytes:
            blocks += [(file, a, min(a + block_bytes, size), size) for a in range(0, size, block_bytes)]
    if not blocks:
        return []
    schema = "file string, start long, end long, size long"
    each = spark.createDataFrame(blocks, schema).repartition(len(blocks), "file", "start")
    found = each.mapInArrow(_passages, f"{schema}, ends array<long>, depths array<long>, lows array<long>, lines long").orderBy("file", "start").collect()
    out: list[dict] = []
    state = depth = line = 0
    for row in found:
        if row["start"] == 0:
            state, depth, line = PLAIN, 0, 1
        out.append({"file": row["file"], "start": row["start"], "end": row["end"], "size": row["size"], "state": state, "depth": depth, "line": line, "top": depth + row["lows"][state] <= 0})
        if depth + row["lows"][state] < 0:
            raise GmlParseError("unexpected ]", line)
        state, depth, line = row["ends"][state], depth + row["depths"][state], line + row["lines"]
        if row["end"] == row["size"] and (depth or state == TEXT):
            raise GmlParseError("unterminated string" if state == TEXT else "unexpected end of file", line)
    touched = [tuple(c[k] for k in ("file", "start", "end", "size", "state", "depth")) for c in out if c["top"]]
    tops = spark.createDataFrame(touched, f"{schema}, state long, depth long").repartition(len(touched), "file", "start")
    told_top = {(r["file"], r["start"]): r for r in tops.mapInArrow(_top, "file string, start long, graph long, last long, bad long").collect()}
    graph: dict[str, int] = {}
    for (file, _), row in sorted(told_top.items()):
        if row["graph"] is not None:
            graph.setdefault(file, row["graph"])
    last: dict[str, int | None] = {}
    for cut in out:
        if cut["file"] not in graph:
            raise GmlParseError("no graph", 1)
        cut["graph"] = graph[cut["file"]]
        cut["inside"] = last.get(cut["file"]) == cut["graph"]
        row = told_top.get((cut["file"], cut["start"]))
        if row and row["bad"]:
            raise GmlParseError("unexpected character", cut["line"])
        if row and row["last"] is not None:
            last[cut["file"]] = row["last"]
    return out


def _bounds(cut: dict) -> tuple[int, int]:
    """Where what a block has begins and ends: after the first blank at or before either place."""

    def aligned(at: int) -> int:
        if at in (0, cut["size"]):
            return at
        start = at - 1
        while start < cut["size"]:
            data = _read_bytes(cut["file"], start, min(start + 4096, cut["size"]))
            if m := _BLANK.search(data):
                return start + m.end()
            start += len(data)
        return cut["size"]

    return aligned(cut["start"]), aligned(cut["end"])


def _keys(tape: _Tape, state: int, depth: int, begin: int, limit: int) -> Iterator[tuple[int, str, int, int]]:
    """(place, key, depth, lines before) of the keys outside of lists or in one alone that begin from ``begin`` on and before ``limit``, places in the file. What is no token is an empty key."""
    origin = tape.file.tell() - len(tape.text)
    limit_at, at, lines = limit - origin, 0, 0
    if state != PLAIN:
        mark = '"' if state == TEXT else "\n"
        while (at := tape.text.find(mark) + 1) == 0 and tape.grow():
            pass
        if not at:
            return
        lines = tape.text.count("\n", 0, at)
    while at < limit_at:
        m = _MARK.search(tape.text, at)
        if (m is None or m.end() == len(tape.text)) and tape.grow():
            continue
        if m is None or m.start() >= limit_at:
            return
        lines += tape.text.count("\n", at, m.start())
        if depth <= 1 and origin + m.start() > begin and (junk := tape.text[max(at, begin - origin) : m.start()].strip()):
            yield origin + m.start() - len(junk), "", depth, lines
        kind = m.lastgroup
        depth += (kind == "open") - (kind == "close")
        if kind == "word" and depth <= 1 and origin + m.start() >= begin:
            yield origin + m.start(), m[0], depth, lines
        lines += m[0].count("\n")
        at = m.end()


def _listed(tape: _Tape, reader: Reader, limit: int) -> Iterator[tuple[int, str, object, int]]:
    """(place, key, value, line) until the list ends, of keys that begin before a place of the tape."""
    while True:
        place, error, found = (reader.at, reader.line), None, None
        try:
            found = reader.item(False)
        except GmlParseError as e:
            error = e
        if (error or reader.at == len(reader.text)) and tape.grow():
            reader.text, (reader.at, reader.line) = tape.text, place
            continue
        begin = re.compile(r"(?:\s+|#[^\n]*)*").match(reader.text, place[0]).end()
        if begin >= limit:
            return
        if error:
            raise error
        if found is None:
            return
        yield begin, *found


def read(cut: dict) -> Iterator[tuple]:
    """(file, fact, a, b, seq, error, line) of the nodes and edges that begin in a block, by their numbers alone, seq being their place."""
    begin, limit = _bounds(cut)
    if begin >= limit:
        return
    tape = _Tape(cut["file"], cut["start"], cut["end"] - cut["start"] + _PIECE)
    start = cut["start"]
    reader = Reader(tape.text)
    if begin <= cut["graph"] < limit:
        reader.at = cut["graph"] - start + len("graph")
        reader.line = cut["line"] + tape.text.count("\n", 0, reader.at)
        while (token := reader.next()) is None and tape.grow():
            reader.text = tape.text
        if token is None or token[0] != "open":
            yield cut["file"], "error", None, None, cut["graph"], failed(reader.fail("no graph")), reader.line
            return
    elif cut["inside"]:
        first = next(_keys(tape, cut["state"], cut["depth"], begin, limit), None)
        if first and first[2] and not first[1]:
            reader.line = cut["line"] + first[3]
            yield cut["file"], "error", None, None, first[0], failed(reader.fail("unexpected character")), reader.line
            return
        if first is None or not first[2]:  # the graph's list may have ended before
            return
        reader.text, reader.at, reader.line = tape.text, first[0] - start, cut["line"] + first[3]
    else:
        return
    at = start + reader.at
    try:
        for place, key, value, line in _listed(tape, reader, limit - start):
            at = start + place
            numbers = told(key, value, line)
            if numbers is not None:
                ends = [str(n) for n in numbers]
                yield cut["file"], key, ends[0], ends[1] if len(ends) > 1 else None, at, None, line
    except (GmlParseError, DanglingEdgeError) as e:
        yield cut["file"], "error", None, None, start + reader.at, failed(e), e.line


def _ends(edges: DataFrame, nodes: DataFrame, declared: DataFrame, side: str) -> DataFrame:
    """Edges with ``times``, how often the id at a side had been declared before them."""
    known = declared.withColumnRenamed("a", side)
    key = F.concat_ws(":", "file", side)
    once = join_lookup(edges.withColumn("_key", key), known.select(key.alias("_key"), "first", "n"), "_key", "seq")
    plain = once.filter(F.coalesce("n", F.lit(0)) <= 1).withColumn("times", (F.coalesce("first", F.lit(1 << 62)) < F.col("seq")).cast("long"))
    again = once.filter("n > 1")
    repeated = nodes.join(declared.filter("n > 1").select("file", "a"), ["file", "a"], "left_semi")
    marks = repeated.select("file", F.col("a").alias(side), "seq", F.lit(1).alias("_node"))
    run = Window.partitionBy("file", side).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = again.withColumn("_node", F.lit(0)).unionByName(marks, allowMissingColumns=True).withColumn("times", F.sum("_node").over(run)).filter("_node = 0")
    return plain.unionByName(mixed.drop("_node")).drop("first", "n", "_key")


def named(facts: DataFrame) -> DataFrame:
    """What blocks told, with ids named as in a whole document, and an error for each edge whose end isn't declared before it."""
    columns = ["file", "fact", "a", "b", "seq", "error", "line"]
    whole = facts.filter(~F.col("part")).select(columns)
    parts = facts.filter("part").select(columns)
    nodes = parts.filter("fact = 'node'")
    declared = nodes.groupBy("file", "a").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("file", "a").orderBy("seq")
    name = lambda side, times: F.when(F.col(times) > 1, F.concat_ws("#", side, F.col(times).cast("string"))).otherwise(F.col(side))
    told_nodes = nodes.withColumn("times", F.row_number().over(order)).withColumn("a", name("a", "times")).select(columns)
    edges = _ends(parts.filter("fact = 'edge'"), nodes, declared, "a").withColumnRenamed("times", "times_a")
    edges = _ends(edges, nodes, declared, "b").withColumnRenamed("times", "times_b")
    missing = F.when(F.col("times_a") == 0, F.col("a")).when(F.col("times_b") == 0, F.col("b"))
    error = F.when(missing.isNotNull(), F.to_json(F.struct(missing.alias("dangling"))))
    told_edges = edges.select("file", F.when(missing.isNotNull(), "error").otherwise(F.col("fact")).alias("fact"), name("a", "times_a").alias("a"), name("b", "times_b").alias("b"), "seq", error.alias("error"), "line")
    return whole.unionByName(told_nodes).unionByName(told_edges).unionByName(parts.filter("fact = 'error'"))
