"""Byte-level BPE: encoding with a contiguous rank array per word, and decoding.

A word's parts are kept as an array of boundaries with, beside it, the rank of each adjacent pair. The smallest
rank is found by scanning the array, its boundary is deleted and the two ranks next to it are looked up again.
That is quickest for short words; a longer word merges through a heap of pairs, with the same result.

Nulls: a null text counts as empty (no ids); a null doc_id is kept. Rows repeat as given; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import slices, texts

SHORT = 64  # bytes up to which the rank array is scanned
PIECES, WORDS = 450_000, 600_000  # entries a worker keeps
WIDTH = 20  # bits of an id
MASK, NONE = (1 << WIDTH) - 1, 1 << 60
_codecs: dict[str, "ByteBPE"] = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, the rest follow from U+0100."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}  # a pair of ids -> its rank, and below that the id it merges into
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.pairs.setdefault(self.ids[a] << WIDTH | self.ids[b], rank << WIDTH | self.ids[a + b])
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.ambiguous = re.compile(r"\s (?:\s|$)|^ | $")
        self.cores: dict[bytes, bytes] = {}  # of a word
        self.marks: dict[str, bytes] = {}
        self.marks = {m: self.word(m.encode()) for m in ".,;:!?"}
        self.known: dict[str, bytes] = {}  # of a piece after a space
        self.heads: dict[str, bytes] = {}  # of a text's first piece
        from tokenizers import pre_tokenizers

        self.level, self.symbols = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), symbols

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        parts = [self.bytes[b] for b in word]
        return self._scan(parts) if len(word) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        """``parts`` holds the id of what lies between two boundaries; ``ranks[i]`` is the rank of parts i and i + 1, with the merged id below it."""
        get = self.pairs.get
        ranks = [get(a << WIDTH | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = least & MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << WIDTH | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << WIDTH | parts[i + 1], NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << WIDTH | parts[i + 1], NONE)) != NONE]
        heapq.heapify(queue)

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := get(parts[i] << WIDTH | parts[j], NONE)) != NONE:
                heapq.heappush(queue, (r, i, parts[i], parts[j]))

        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = r & MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p >= 0]

    def word(self, word: bytes) -> bytes:
        ids = self.cores.get(word)
        if ids is None:
            merged = self.merge(word)
            ids = struct.pack(f"<{len(merged)}I", *merged)
            if len(self.cores) >= WORDS:
                self.cores.clear()
            self.cores[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        core = piece[:-1] if piece[-1:] in self.marks else piece
        if core[1:].isalpha() and core.isascii() and (core[0] == " " or core[0].isalpha()):  # the common case, without the pattern
            return self.word(core.encode()) + self.marks.get(piece[len(core) :], b"")
        if piece.isascii() or max(piece) < "̀":
            words = [w.encode() for w in self.words.findall(piece)]
        else:  # pre-tokenised by the library, whose Unicode tables decide what a letter is
            words = [bytes(self.symbols[c] for c in w) for w, _ in self.level.pre_tokenize_str(piece)]
        return b"".join([self.word(w) for w in words])

    def plain(self, text: str) -> bytes:
        """A text without special tokens. A boundary always precedes a space that follows no white space or is followed by none, so such pieces are encoded once and remembered."""
        if not text:
            return b""
        if self.ambiguous.search(text):
            return self.piece(text)
        first, *rest = text.split(" ")
        known, heads = self.known, self.heads
        if first not in heads:
            if len(heads) >= PIECES:
                heads.clear()
            heads[first] = self.piece(first)
        try:
            return heads[first] + b"".join([known[p] for p in rest])
        except KeyError:
            if len(known) >= PIECES:
                known.clear()
            for p in set(rest).difference(known):
                known[p] = self.piece(" " + p)
            return heads[first] + b"".join([known[p] for p in rest])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; a special token's own string becomes its id."""
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        parts = self.specials.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def codec(path: str) -> ByteBPE:
    if path not in _codecs:
        _codecs[path] = ByteBPE(path)
    return _codecs[path]


def encode(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in slices(batches, "text"):
            ids = [bpe.encode(t.decode()) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """Adds ``text``, decoded from the ids; special tokens are written out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in slices(batches, "ids"):
            out = [bpe.decode(np.frombuffer(i or b"", "<u4")) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(work, "doc_id long, n_tokens long, ids binary, text string")
