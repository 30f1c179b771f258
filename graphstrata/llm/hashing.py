"""Hashes of many stretches of text at once.

Texts are laid end to end in a byte buffer of bounded size, with padding between them.
One running sum of powers over the buffer gives a 64-bit polynomial hash of any stretch
in constant time, wherever it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 1 << 19
PAD = 32

_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, BLOCK_BYTES * 5 // 4)
        _tables[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables.append(np.cumprod(steps))
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Block(NamedTuple):
    """Texts ``first`` to ``first + len(begin) - 1``; text i is data[begin[i]:end[i]]."""

    first: int
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def _raw(texts: list[str | None] | pa.Array) -> Iterator[bytes]:
    """UTF-8, one text at a time: a batch is never held a second time as objects."""
    if isinstance(texts, pa.Array):
        yield from (t.as_py() or b"" for t in texts.cast(pa.binary()))
    else:
        yield from ((t or "").encode("utf-8", "surrogatepass") for t in texts)


def blocks(texts: list[str | None] | pa.Array, pad: bytes) -> Iterator[Block]:
    """The texts as UTF-8, in blocks that hold one text at least; a longer text is a block of its own."""
    parts: list[bytes] = []
    size = first = 0

    def cut() -> Block:
        lengths = np.array([len(p) for p in parts], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]]) + PAD
        gap = pad * PAD
        return Block(first, np.frombuffer(gap + gap.join(parts) + gap, np.uint8), begin, begin + lengths)

    for i, raw in enumerate(_raw(texts)):
        if parts and size + len(raw) > BLOCK_BYTES:
            yield cut()
            parts, size, first = [], 0, i
        parts.append(raw)
        size += len(raw) + PAD
    if parts:
        yield cut()


class Sums:
    """Running sums over a buffer, and from them the hash of any stretch."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] ^ (end - begin).astype(np.uint64) * _LENGTH)
