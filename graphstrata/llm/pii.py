"""Personal data in plain sight and in disguise, with spans in the source text.

Plain identifiers are found in the text as it stands. Then a chain of transducers
undoes disguises (look-alike letters, spelled digits, written-out "at" and "dot"),
each keeping for every character it writes the stretch of source it came from;
identifiers found in the normalised text are mapped back through those stretches.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]
Piece = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from the others: looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    floor = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        begin = floor + len(text[floor:at].rstrip(_LOCAL))
        floor = at + 1  # no local part holds an @
        if begin < at:
            yield begin, m.end(), "email"
            floor = m.end()


def _numbers(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield m.start(), m.end(), "ip"
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.start(), m.end(), "phone"


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind, by start, then kind."""
    found = [*(_emails(text) if "@" in text else ()), *_numbers(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# Letters of other scripts that look like Latin ones.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}
# The digits' names in the languages of the corpus.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_ODD = re.compile("[" + "".join(map(re.escape, _ALIKE)) + "٠-٩۰-۹！-～①-⑳⁰-₉²³¹\U0001d400-\U0001d7ff]")
_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase|klammeraffe|@)", r"(?:dot|punkt|punto|point|\.)"
_OPEN, _CLOSE = r"[\[({<]{1,2}\s{0,3}", r"\s{0,3}[\])}>]{1,2}"
_BRACKETED = re.compile(rf"(?i)\s{{0,3}}{_OPEN}(?:(?P<at>{_AT_WORD})|(?P<dot>{_DOT_WORD})){_CLOSE}\s{{0,3}}")
# A written address lies around its "at": a chain of parts before it, a chain of labels after it, dots or worded dots between.
# White space is looked at from where it begins only, and a chain never leaves the stretch between two "at", so a text is read twice at most.
_AT = re.compile(r"(?i)(?<!\s)\s*@\s*|(?<!\s)\s+(?:at|(?P<sign>arroba|arobase|klammeraffe))\s+")
_DOT_BEFORE = re.compile(r"(?i)(?:\A|\s)(?:dot|punkt|punto|point)\Z")  # what follows is an ending, as in "firma punkt at"
_DOT = re.compile(rf"(?i)\.|\s+(?P<word>{_DOT_WORD})\s+")
_LOCAL_CHAIN = re.compile(rf"(?i)(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:(?:\.|\s+{_DOT_WORD}\s+)[A-Za-z0-9_%+-]+)*")
_DOMAIN_CHAIN = re.compile(rf"(?i)[A-Za-z0-9-]+(?:(?:\.|\s+{_DOT_WORD}\s+)[A-Za-z0-9-]+)*")
# Long endings of domains that need no other sign; words of two letters that are endings too, and those that are none;
# words that stand before a "dot" or a "point" in prose, and before its "at".
_LONG_ENDS = frozenset("com net org edu gov mil int info biz name pro app dev online site".split())
_WORD_ENDS = frozenset("am as at be by do go in is it me my no so to us we".split())
_NO_ENDS = frozenset("an ah eh he if of oh ok on or up".split())
_ARTICLES = frozenset("the a an this that these each every any some which what one my your his her our their its no dot point".split())
_BEFORE_AT = frozenset("look looks looked looking stare stared staring gaze gazed point points pointed aim aimed arrive arrived works worked meet met meets me us him her them it stay stayed stop stopped is are was were be been".split())
_DIGIT_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_MIXED = re.compile(rf"\b(?:{_DIGIT_WORD})(?:[\s,-]{{1,3}}|\s*(?:\.|dot|point|punkt|punto)\s*)(?:{_DIGIT_WORD}|[0-9])|[0-9](?:[\s,-]{{1,3}}|\s*(?:\.|dot|point|punkt|punto)\s*)(?:{_DIGIT_WORD})\b|[0-9]\s*(?:dot|point|punkt|punto)\s*[0-9]")
_AT_GATE, _DOT_GATE = re.compile(r"@|\s(?:at|arroba|arobase|klammeraffe)\s"), re.compile(rf"\s{_DOT_WORD}\s")
_DIGIT_RUN = re.compile(rf"(?i)(?<!\w)(?:plus\s+)?(?:{_DIGIT_WORD}|[0-9]+)(?:(?:[\s,-]{{1,3}}|\s*(?:\.|dot|point|punkt|punto)\s*)(?:{_DIGIT_WORD}|[0-9]+)(?!\w))+")
_IN_RUN = re.compile(rf"(?i)(?P<plus>plus\s+)|(?P<word>{_DIGIT_WORD})|(?P<dot>\s*(?:\.|dot|point|punkt|punto)\s*)|(?P<gap>[\s,-]{{1,3}})|(?P<digit>[0-9])")
#: Digits spelled out that make a run a disguise whatever it gives; with fewer, or worded dots, it must give an identifier.
_LEAST_SPELLED = 4


class Mapped:
    """Text whose every character knows the stretch of source that it stands for."""

    def __init__(self, text: str, begin: list[int], end: list[int]):
        self.text, self.begin, self.end = text, begin, end

    @classmethod
    def of(cls, source: str) -> Mapped:
        return cls(source, list(range(len(source))), list(range(1, len(source) + 1)))

    def sub(self, pattern: re.Pattern, write: Callable[[re.Match], list[Piece] | None]) -> Mapped:
        """Replace matches by what ``write`` gives; None leaves a match."""
        return self.put((m.start(), m.end(), pieces) for m in pattern.finditer(self.text) if (pieces := write(m)) is not None)

    def put(self, changes: Iterable[tuple[int, int, list[Piece]]]) -> Mapped:
        """Replace stretches, which come in order, by pieces of text, each with its stretch of this text."""
        out, begin, end, at = [], [], [], 0
        for start, stop, pieces in changes:
            out.append(self.text[at:start])
            begin += self.begin[at:start]
            end += self.end[at:start]
            for piece, lo, hi in pieces:
                out.append(piece)
                begin += [self.begin[lo]] * len(piece)
                end += [self.end[hi - 1]] * len(piece)
            at = stop
        if not at:
            return self
        return Mapped("".join([*out, self.text[at:]]), begin + self.begin[at:], end + self.end[at:])

    def span(self, lo: int, hi: int) -> tuple[int, int]:
        return self.begin[lo], self.end[hi - 1]


def _plain_letter(m: re.Match) -> list[Piece]:
    c = m[0]
    return [(_ALIKE[c] if c in _ALIKE else unicodedata.normalize("NFKC", c), m.start(), m.end())]


def _sign(m: re.Match) -> list[Piece]:
    return [("@" if m["at"] else ".", m.start(), m.end())]


def _digits(m: re.Match) -> list[Piece] | None:
    out, spelled, worded, at, was_word = [], 0, False, m.start(), False
    while at < m.end():
        t = _IN_RUN.match(m.string, at, m.end())
        if t is None:
            return None
        if t["plus"]:
            out.append(("+", t.start(), t.end()))
        elif t["word"]:
            spelled += 1
            out.append((_SPELLED[t["word"].lower()], t.start(), t.end()))
            was_word = True
        elif t["digit"]:
            out.append((t["digit"], t.start(), t.end()))
            was_word = False
        elif t["dot"]:
            worded = worded or t["dot"].strip() != "."
            out.append((".", t.start(), t.end()))
        elif not was_word:
            out.append((" ", t.start(), t.end()))
        at = t.end()
    if spelled < _LEAST_SPELLED:
        written = ("+" if m.string[m.start() - 1 : m.start()] == "+" else "") + "".join([piece for piece, _, _ in out])
        if not (spelled or worded) or next(_numbers(written), None) is None:
            return None
    return out


def _ending(end: str, first: str, dot: str, local: str, at_sign: bool, parts: bool) -> int:
    """How well a label ends a written address: 2 surely, 1 by its form alone, 0 not."""
    end, first = end.lower(), first.lower()
    if not end.isalpha() or len(end) < 2 or end in _NO_ENDS or end in _ARTICLES or _DOT.fullmatch(f" {end} "):
        return 0
    known = end in _LONG_ENDS or len(end) == 2
    if at_sign:
        return 1 + (known and end not in _WORD_ENDS)
    if local.lower() in _BEFORE_AT and not parts:
        return 0
    if end in _LONG_ENDS or len(end) == 2 and end not in _WORD_ENDS:
        return 2
    if first in _ARTICLES or dot == "point" and not parts:
        return 0
    return 2 if known else int(parts or dot == "dot")


def _addresses(text: str) -> Iterator[tuple[int, int, list[Piece]]]:
    """Written addresses, with signs for their words."""
    signs = [m for m in _AT.finditer(text) if "@" in m[0] or not _DOT_BEFORE.search(text[max(m.start() - 7, 0) : m.start()])]
    floor = 0
    for i, at in enumerate(signs):
        local = None
        for local in _LOCAL_CHAIN.finditer(text, floor, at.start()):
            pass
        floor = at.end()
        if local is None or local.end() != at.start():
            continue
        domain = _DOMAIN_CHAIN.match(text, at.end(), signs[i + 1].start() if i + 1 < len(signs) else len(text))
        if domain is None:
            continue
        dots = list(_DOT.finditer(text, domain.start(), domain.end()))
        edges = [domain.start(), *(d.end() for d in dots)], [*(d.start() for d in dots), domain.end()]
        labels = [text[lo:hi] for lo, hi in zip(*edges, strict=True)]
        parts = [d for d in _DOT.finditer(text, local.start(), local.end())]
        taken = 0
        for k in range(len(dots), 0, -1):
            stop = edges[1][k]
            if dots[k - 1]["word"] is None or k == len(dots) and (text[stop : stop + 1].isalnum() or text[stop : stop + 1] == "_"):
                continue
            fit = _ending(labels[k], labels[0], dots[k - 1]["word"].lower(), local[0], "@" in at[0] or at["sign"] is not None, bool(parts))
            if fit and not taken or fit == 2:
                taken = k
            if fit == 2:
                break
        if taken:
            begin, stop = local.start(), edges[1][taken]
            pieces, last = [], begin
            for s in [*parts, at, *dots[:taken]]:
                pieces += [(text[j], j, j + 1) for j in range(last, s.start())]
                pieces.append(("@" if s is at else ".", s.start(), s.end()))
                last = s.end()
            yield begin, stop, pieces + [(text[j], j, j + 1) for j in range(last, stop)]
            floor = stop


def normalised(text: str) -> Mapped | None:
    """The text without disguises; None if it has none."""
    odd = not text.isascii() and _ODD.search(text)
    low = text.lower()
    bracketed = any(c in low for c in "[({<") and _BRACKETED.search(text)
    written = _AT_GATE.search(low) and _DOT_GATE.search(low)
    spelled = _MIXED.search(low)
    if not (odd or bracketed or written or spelled):
        return None
    now = Mapped.of(text)
    if odd:
        now = now.sub(_ODD, _plain_letter)
    now = now.sub(_BRACKETED, _sign)
    now = now.sub(_DIGIT_RUN, _digits)
    return now.put(_addresses(now.text))


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows; none that a plain span of its kind covers."""
    now = normalised(text)
    if now is None or now.text == text:
        return []
    held: dict[str, tuple[list[int], list[int]]] = {kind: ([], []) for kind in KINDS}
    for b, e, kind in sorted(base):  # of one kind they don't overlap, so the last to begin before a span is the one that may cover it
        held[kind][0].append(b)
        held[kind][1].append(e)
    found = set()
    for lo, hi, kind in plain_spans(now.text):
        b, e = now.span(lo, hi)
        begins, ends = held[kind]
        at = bisect_right(begins, b)
        if not at or ends[at - 1] < e:
            found.add((b, e, kind))
    return sorted(found, key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join([f"{kind}:{b}:{e}" for b, e, kind in spans])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "has_pii"]
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        digests, spans, totals = [], [], []
        for text in batch.column("text"):  # one text at a time
            text = text.as_py() or ""
            base = plain_spans(text)
            every = sorted([*base, *hidden_spans(text, base)], key=_order)
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(s[2] == kind for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
            totals.append(len(every))
        columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(totals, pa.int64()), pa.array([n > 0 for n in totals], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of plain spans, all spans, their number, and whether there is one, for each row of ``docs``.

    Null and empty texts have no spans; whole texts of any length are searched in linear
    time; a null id stays null; repeated rows count each; an empty table gives an empty
    result; other columns are not read. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, has_pii boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_found, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``; nulls, repeats and empty tables as in ``find_pii``."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
