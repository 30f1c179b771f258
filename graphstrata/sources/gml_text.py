"""The grammar of GML: tokens, nested lists, and the nodes and edges that a graph's list tells."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from graphstrata.model import DanglingEdgeError, GmlParseError

_SKIP = re.compile(r"(?:\s+|#[^\n]*)*")
_TOKEN = re.compile(r'(?P<open>\[)|(?P<close>\])|(?P<word>[A-Za-z_]\w*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|"(?P<text>[^"]*)"')


class Reader:
    """Tokens of a document with their lines, and the nested lists that they form."""

    def __init__(self, text: str):
        self.text, self.at, self.line = text, 0, 1

    def fail(self, message: str) -> GmlParseError:
        return GmlParseError(message, self.line)

    def next(self) -> tuple[str, object] | None:
        gap = _SKIP.match(self.text, self.at)
        self.line += self.text.count("\n", self.at, gap.end())
        self.at = gap.end()
        if self.at == len(self.text):
            return None
        m = _TOKEN.match(self.text, self.at)
        if m is None:
            raise self.fail("unterminated string" if self.text[self.at] == '"' else f"unexpected character {self.text[self.at]!r}")
        self.at = m.end()
        kind = m.lastgroup
        value: object = m[kind]
        if kind == "number":
            value = int(m[kind]) if re.fullmatch(r"[+-]?\d+", m[kind]) else float(m[kind])
        if kind == "text":
            self.line += m[0].count("\n")
        return kind, value

    def item(self, top: bool) -> tuple[str, object, int] | None:
        """The next key with its value and line; None where the list ends."""
        token = self.next()
        if token is None or token[0] == "close":
            if (token is None) != top:
                raise self.fail("unexpected end of file" if token is None else "unexpected ]")
            return None
        if token[0] != "word":
            raise self.fail(f"expected a key, found {token[1]!r}")
        line, value = self.line, self.next()
        if value is None or value[0] in ("close", "word"):
            raise self.fail(f"{token[1]} has no value")
        return str(token[1]), list(self.items(False)) if value[0] == "open" else value[1], line

    def items(self, top: bool) -> Iterator[tuple[str, object, int]]:
        """All items until the list ends. A list is read before the key after it is asked for."""
        while (found := self.item(top)) is not None:
            yield found


def _whole(items: list, key: str) -> int | None:
    return next((v for k, v, _ in items if k == key and type(v) is int), None)


def told(key: str, value: object, line: int) -> tuple[int, ...] | None:
    """(id,) of a node, (source, target) of an edge, None of anything else in a graph."""
    if key not in ("node", "edge"):
        return None
    if not isinstance(value, list):
        raise GmlParseError(f"{key} is not a list", line)
    if key == "node":
        i = _whole(value, "id")
        if i is None:
            raise GmlParseError("node without id", line)
        return (i,)
    ends = tuple(_whole(value, k) for k in ("source", "target"))
    for end, k in zip(ends, ("source", "target"), strict=True):
        if end is None:
            raise GmlParseError(f"edge without {k}", line)
    return ends


def parse(text: str) -> Iterator[tuple[str, str, str | None]]:
    """("node", id, None) and ("edge", source, target) of the graph, ids with a number for each time that they are declared."""
    reader = Reader(text)
    graphs = [v for k, v, _ in reader.items(True) if k == "graph"]
    if not graphs or not isinstance(graphs[0], list):
        raise reader.fail("no graph")
    times: dict[int, int] = {}

    def name(i: int) -> str:
        return f"{i}" if times[i] == 1 else f"{i}#{times[i]}"

    for key, value, line in graphs[0]:
        said = told(key, value, line)
        if said is None:
            continue
        if key == "node":
            i = said[0]
            times[i] = times.get(i, 0) + 1
            yield "node", name(i), None
            continue
        for end in said:
            if end not in times:
                raise DanglingEdgeError(str(end), line)
        yield "edge", name(said[0]), name(said[1])


def failed(e: GmlParseError | DanglingEdgeError) -> str:
    """An error as text that a row can carry."""
    return json.dumps({"dangling": e.node_id} if isinstance(e, DanglingEdgeError) else {"message": str(e)})


def rows(file: str, text: str) -> list[tuple]:
    """(file, fact, a, b, seq, error, line) of a whole document; an error is its last row."""
    out: list[tuple] = []
    try:
        for fact, a, b in parse(text):
            out.append((file, fact, a, b, len(out), None, None))
    except (GmlParseError, DanglingEdgeError) as e:
        out.append((file, "error", None, None, len(out), failed(e), e.line))
    return out
