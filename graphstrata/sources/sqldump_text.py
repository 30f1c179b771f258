"""The lines of SQL dumps: a small state machine that writes facts."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = r"(?:`[^`]+`|[A-Za-z0-9_$]+)(?:\.(?:`[^`]+`|[A-Za-z0-9_$]+))?"
_CREATE = re.compile(r"(?i)CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(`[^`]+`(?:\.`[^`]+`)?)")
_OTHER_CREATE = re.compile(r"(?i)^CREATE\b.*\b(PROCEDURE|FUNCTION|TRIGGER|EVENT|VIEW|DATABASE)\b")
_ALTER = re.compile(rf"(?i)ALTER\s+TABLE\s+(?:ONLY\s+)?({_NAME})")
_REFERENCE = re.compile(rf"(?i)\bFOREIGN\s+KEY\b.*?\bREFERENCES\s+({_NAME})")
_MENTION = re.compile(rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+({_NAME})")
_USE = re.compile(r"USE\s+(?:`([^`]+)`|([^;]*))")
_DELIMITER = re.compile(r"DELIMITER\s+(\S+)")
_CLOSES = re.compile(r"(?i)^\)|\)\s*ENGINE=|;$")
# Words that follow a keyword without being a table.
_NO_TABLE = frozenset("select set outfile dumpfile low_priority ignore values dual".split())


def _plain(name: str) -> str:
    return name.replace("`", "")


def _qualified(name: str, database: str) -> str:
    name = _plain(name)
    return f"{database}.{name}" if database and "." not in name else name


def _uncommented(line: str) -> str:
    """A comment is a line of its own, or follows a dash pair between blanks; a # inside a line may be part of a value."""
    line = line.strip()
    if line.startswith(("--", "#")) or line.startswith("/*") and "*/" in line:
        return ""
    return line.split(" -- ")[0].strip()


def facts(text: str) -> Iterator[tuple[int, str, str, str | None, int | None]]:
    """(line, "table" | "fk" | "mention", a, b, routine): a table; a reference from a to b; a table that a routine names."""
    database, table, routine, in_routine = "", None, 0, False
    for number, raw in enumerate(text.splitlines(), 1):
        line = _uncommented(raw)
        if not line:
            continue
        if m := _USE.match(line):
            database = m[1] or m[2].strip()
            continue
        if m := _DELIMITER.match(line):
            in_routine, table = m[1] != ";", None
            routine += in_routine
            continue
        if in_routine:
            for m in _MENTION.finditer(line):
                if _plain(m[1]).lower() not in _NO_TABLE:
                    yield number, "mention", _qualified(m[1], database), None, routine
            continue
        if table is None:
            if _OTHER_CREATE.match(line) and not _CREATE.match(line):
                continue
            if m := _CREATE.match(line):
                table = _qualified(m[1], database)
                yield number, "table", table, None, None
                line = line[m.end() :]
            elif m := _ALTER.match(line):
                if r := _REFERENCE.search(line, m.end()):
                    yield number, "fk", _qualified(m[1], database), _qualified(r[1], database), None
                continue
            else:
                continue
        if r := _REFERENCE.search(line):
            yield number, "fk", table, _qualified(r[1], database), None
        if _CLOSES.search(line):
            table = None
