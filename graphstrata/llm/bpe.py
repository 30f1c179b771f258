"""BPE encoding and decoding with a vocabulary of whole-word endings.

Short words are merged over a contiguous rank array: the boundaries of the parts and
the rank of each adjacent pair lie in two flat lists, the smallest rank is found by a
scan, a boundary is deleted, and the two neighbouring ranks are looked up again. Words
too long for scans take the same merges from a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NO_RANK = 1 << 60
_SCAN_UP_TO = 96  # parts; above, a scan for each merge would be quadratic
_CACHED_WORDS = 60_000  # of two generations each; words not asked for again go with the older: a bound on memory, not on words
_CACHED_LENGTH = 64


def _byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable in Latin-1, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


def _class_of(name: str) -> str:
    """The library's characters of a class, as ranges to stand between brackets."""
    from tokenizers import Regex, pre_tokenizers

    others = pre_tokenizers.Split(Regex(f"[^{name}]+"), "removed")
    ranges: list[list[int]] = []
    for lo in [*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x800)]:  # all but the surrogates
        for _, (a, b) in others.pre_tokenize_str("".join(map(chr, range(lo, lo + 0x800)))):
            if ranges and ranges[-1][1] == lo + a:
                ranges[-1][1] = lo + b
            else:
                ranges.append([lo + a, lo + b])
    return "".join([f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in ranges])


class WordBPE:
    """Reads the vocabulary file; ``encode`` and ``decode`` follow its normaliser, splitter and merges.

    Letters, numbers and small letters are those of the installed Unicode tables; texts with
    characters that these don't know go by those of the tokenizers library, asked once a process.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        self.path, self.split, self.seen, self.library = path, split, set(), None
        self.ascii_words = re.compile(split.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.final[raw[-1]])
        return self._scan(ids) if len(ids) <= _SCAN_UP_TO else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        known = self.ranks.get
        none = (_NO_RANK, 0)
        found = [known(p, none) for p in zip(ids, ids[1:])]
        rank = [f[0] for f in found]
        into = [f[1] for f in found]
        while rank:
            low = min(rank)
            if low == _NO_RANK:
                break
            i = rank.index(low)
            ids[i] = into[i]
            del ids[i + 1], rank[i], into[i]
            if i < len(rank):
                rank[i], into[i] = known((ids[i], ids[i + 1]), none)
            if i:
                rank[i - 1], into[i - 1] = known((ids[i - 1], ids[i]), none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*self.ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heap = [(rank, i, into, p) for rank, into, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, into, (left, right) = heapq.heappop(heap)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = into, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in self.ranks:
                    rank, merged = self.ranks[ids[a], ids[b]]
                    heapq.heappush(heap, (rank, a, merged, (ids[a], ids[b])))
        return [t for t in ids if t >= 0]

    def _word(self, word: str) -> bytes:
        out = self.cache.get(word) or self.older.get(word) or np.array(self.merge(word), "<u4").tobytes()
        if len(word) <= _CACHED_LENGTH:
            if len(self.cache) >= _CACHED_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[word] = out
        return out

    def _newer(self, text: str) -> bool:
        """Whether a text has a character that the installed tables don't know."""
        unseen = set(text) - self.seen
        if any(unicodedata.category(c) == "Cn" for c in unseen):
            return True
        self.seen |= unseen
        return False

    def _library_words(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            pattern = self.split
            for name in (r"\p{L}", r"\p{N}", r"\s"):
                pattern = pattern.replace(name, _class_of(name))
            self.library = Tokenizer.from_file(self.path).normalizer.normalize_str, re.compile(pattern).findall
        normal, words = self.library
        return words(normal(text))

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = self.ascii_words(text.lower())
        elif self._newer(text):
            words = self._library_words(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the file lowers letter by letter: no final sigma
            words = self.words(text.lower())
        known = self.cache.get
        return b"".join([known(w) or self._word(w) for w in words])

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.specials or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by a space."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column("text").to_pylist():
                raw = bpe.encode_bytes(text or "")
                decoded = bpe.decode(np.frombuffer(raw, "<u4").tolist())
                counts.append(len(raw) // 4)
                ids_hex.append(hashlib.sha256(raw).hexdigest())
                text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row. A null or empty text has no ids; repeated rows and other columns change nothing."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text decoded from them, one row for each row of ``docs``.

    A null text counts as empty; a null doc_id stays null; an empty table gives an empty
    result. No shuffle: every row is handled where it is read. A very long text is a batch of its own.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests(path), SCHEMA)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text of ``documents``, encoded and decoded; nulls, repeats and empty tables as in ``digest_documents``."""
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
