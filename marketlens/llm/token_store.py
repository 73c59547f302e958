"""Token-id output: documents as ids in blocks of separately compressed frames under one shared dictionary.

A store is a folder of two Parquet tables. ``dictionary`` holds the zstandard dictionary with its SHA-256.
``blocks`` holds, in ascending document order, rows of about a megabyte: the frames of consecutive documents
in one binary value, the offset index (document ids, byte offsets, token counts), the number of ids before the
block within its shard, and the hash of the dictionary its frames need. A reader prunes blocks by document id
and decompresses one short frame, never the block.

Nulls: a null text is an empty text (only the end id); a null doc_id sorts first and is kept. Repeated ids are
kept next to each other. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm import common
from marketlens.llm.bpe import byte_symbols
from marketlens.llm.common import flat, laid_out, lower, shuffle_partitions, slices, tidy, written
from marketlens.sources.scratch import tables_dir

CHUNKS, WORDS = 800_000, 800_000  # entries a worker keeps of either memo
SLICE = 4 << 20  # bytes of text that are cut into units together

# classes of bytes, and after which class a byte of which begins a unit
SPACE, LETTER, DIGIT, QUOTE, MARK, WIDE = range(6)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]], _CLASS[39], _CLASS[128:] = SPACE, QUOTE, WIDE
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = DIGIT, LETTER, LETTER
_BEGINS = np.zeros((6, 8), bool)
_BEGINS[SPACE] = True
_BEGINS[[LETTER, MARK], DIGIT] = _BEGINS[QUOTE, DIGIT] = _BEGINS[DIGIT, : MARK + 1] = True
_BEGINS[LETTER, [QUOTE, MARK]] = _BEGINS[MARK, LETTER] = True  # what follows an apostrophe may belong to it


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of texts that ``flat`` laid out, A-Z lower-cased, with the n + 1 bounds of each text's.

    Units are space-free chunks, cut further between two ASCII characters where the tokenizer's pattern always cuts:
    beside digits, after letters, and before letters but after an apostrophe. A text that may name a special token,
    which is found before lower-casing, is one unit as it is.
    """
    kind = _CLASS[data]
    begins, inside = np.ones(len(data), bool), kind != SPACE
    begins[1:] = _BEGINS.ravel()[kind[:-1] * np.uint8(8) + kind[1:]]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    low = lower(data)
    if b"<|" in data.tobytes():
        at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        owner = np.searchsorted(offsets, at, "right") - 1
        for d in np.unique(owner[at + 1 < offsets[owner + 1]]).tolist():
            a, b = int(offsets[d]), int(offsets[d + 1])
            inside[a:b], begins[a + 1 : b], low[a:b] = True, False, data[a:b]
    starts = np.flatnonzero(begins[inside])
    before = offsets - np.searchsorted(np.flatnonzero(~inside), offsets)
    ends = np.append(starts, before[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])]), np.searchsorted(starts, before)


class _Known(dict):
    """What ``make`` makes of units, made where it is missing."""

    def __init__(self, make: Callable[[str], Any]):
        self.make = make

    def __missing__(self, unit: bytes) -> Any:
        made = self.make(unit.decode())
        if b"<|" not in unit:  # else a whole text
            self[unit] = made
        return made


class _Merges:
    """Counts the ids of many words at once, by the merges of a byte-level model whose words' last symbols are marked.

    Words of one length are rows of a matrix of ids. In each round every row merges its pair of least rank, the leftmost
    of equals, so all rows lose one column; rows without a pair to merge are done.
    """

    NONE, LONGEST = 1 << 30, 32

    def __init__(self, model: dict, stand_ins: dict[int, str]):
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.bytes = np.array([vocab[stand_ins[b]] for b in range(256)], np.uint32)
        self.last = np.array([vocab[stand_ins[b] + end] for b in range(256)], np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        bits = (8 * len(pairs)).bit_length()
        self.shift, self.most = np.uint64(64 - bits), (1 << bits) - 1
        keys, ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.NONE, np.int32)
        every = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        for rank, (key, slot) in enumerate(zip(every.tolist(), self.slots(every).tolist())):
            while ranks[slot] != self.NONE and keys[slot] != key:  # taken: the next one
                slot = slot + 1 & self.most
            if ranks[slot] == self.NONE:  # of equal pairs the first counts
                keys[slot], ranks[slot] = key, rank
        self.keys, self.table = keys, ranks

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32) | right).ravel()
        slots = self.slots(keys)
        out = self.table.take(slots)
        other = np.flatnonzero((self.keys.take(slots) != keys) & (out != self.NONE))
        while len(other):  # on to the next slot until the pair or a free one comes
            slots[other] = slots[other] + 1 & self.most
            out[other] = self.table[slots[other]]
            other = other[(self.keys[slots[other]] != keys[other]) & (out[other] != self.NONE)]
        return out.reshape(left.shape)

    def sizes(self, words: list[bytes]) -> list[int]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            for at in range(0, len(rows), 2048):
                some = rows[at : at + 2048]
                out[some] = self._alike(data[starts[some][:, None] + np.arange(n)])
        return out.tolist()

    def _alike(self, words: np.ndarray) -> np.ndarray:
        parts = self.bytes[words]
        parts[:, -1] = self.last[words[:, -1]]
        ranks, row = self.ranks(parts[:, :-1], parts[:, 1:]), np.arange(len(parts))
        out = np.ones(len(parts), np.int64)
        while (left := parts.shape[1]) > 1:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            go = least < self.NONE
            if not go.all():
                out[row[~go]] = left
                parts, ranks, row, at, least = parts[go], ranks[go], row[go], at[go], least[go]
            if not len(row):
                break
            each = np.arange(len(row))
            parts[each, at] = self.made[least]
            keep = np.arange(1, left) != (at + 1)[:, None]  # of the parts but the first, and of the ranks: the merged pair goes
            parts = np.concatenate([parts[:, :1], parts[:, 1:][keep].reshape(len(row), left - 2)], axis=1)
            ranks = ranks[keep].reshape(len(row), left - 2)
            for some, x in ((np.flatnonzero(at > 0), -1), (np.flatnonzero(at < left - 2), 0)):
                i, j = each[some], at[some] + x
                ranks[i, j] = self.ranks(parts[i, j], parts[i, j + 1])
        return out


class ChunkEncoder:
    """Encodes with the tokenizers library, each distinct unit of a text once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks, and a chunk's
    those of its units. ``encode_all`` finds the units of many texts at once and looks up the distinct ones. A plain
    chunk (printable, below U+0300, where composition and lower-casing go letter by letter) is cut by the
    tokenizer's own split pattern and its words go to the library's model; any other chunk goes to the library whole.
    """

    def __init__(self, path: str, chunks: int = CHUNKS, words: int = WORDS):
        self.most_chunks, self.most_words = chunks, words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.known, self.sizes = _Known(self.unit), _Known(lambda unit: len(self.unit(unit)) // self.type.itemsize)
        self.merges: _Merges | None = None
        self.tokenize, self.packed = self.tokenizer.model.tokenize, [i.to_bytes(self.type.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.stand_ins = {b: c for c, b in byte_symbols().items()}
        self.marks: dict[str, bytes] = {}
        self.marks = {m: self.word(m) for m in ".,;:!?"}

    def spell(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.stand_ins)

    def model(self, word: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.tokenize(word if word.isascii() else self.spell(word))])

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.model(word)
            if len(self.words) >= self.most_words:
                self.words.clear()
            self.words[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        core = chunk[:-1] if chunk[-1:] in self.marks else chunk
        if core.isascii() and core.isalpha():  # the common case, without the pattern
            return self.word(core.lower()) + self.marks.get(chunk[len(core) :], b"")
        if chunk.isprintable() and max(chunk, default="") < "̀" and "<|" not in chunk:
            return b"".join([self.word(w) for w in self.split.findall(chunk.lower())])
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.type).tobytes()

    @staticmethod
    def one_word(low: str) -> bool:
        return low.isalpha() and (low.isascii() or max(low) < "̀")

    def unit(self, unit: str) -> bytes:
        low = unit.lower()
        if self.one_word(low):  # without the pattern and the memo of words
            return self.model(low)
        return self.encode(unit) if "<|" in unit else self.chunk(unit)

    def encode_all(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the n + 1 bounds of each text's) of texts as ``flat`` lays them out; ``end_id`` closes each text."""
        ids, code, bounds = self._coded(self.known, data, offsets)
        if end_id is not None:
            code = np.insert(code, bounds[1:], len(ids))
            bounds = bounds + np.arange(len(bounds))
            ids.append(self.packed[end_id])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.type.itemsize
        firsts = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], np.cumsum(sizes[code])])
        at = np.repeat(firsts[code] - before[:-1], sizes[code]) + np.arange(before[-1])
        return np.frombuffer(b"".join(ids), self.type)[at], before[bounds]

    def count_all(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        sizes, code, bounds = self._coded(self.sizes, data, offsets, self._count_words)
        return np.diff(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64)[code])])[bounds])

    def _count_words(self, fresh: list[bytes]) -> None:
        """Counts those of the units that are one word by merging all of them at once."""
        if self.merges is None:
            self.merges = _Merges(json.loads(self.tokenizer.to_str())["model"], self.stand_ins)
        words = [(u, u if u.isalpha() else low.encode()) for u in fresh if len(u) <= _Merges.LONGEST and (u.isalpha() or self.one_word(low := u.decode().lower()))]
        self.sizes.update(zip([u for u, _ in words], self.merges.sizes([w for _, w in words])))

    def _coded(self, known: _Known, data: np.ndarray, offsets: np.ndarray, learn: Callable[[list[bytes]], None] = lambda fresh: None) -> tuple[list, np.ndarray, np.ndarray]:
        """What is known of each distinct unit, the units of all texts as places in that list, and the bounds of each text's."""
        every, bounds = units(data, offsets)
        coded = every.dictionary_encode()
        if len(known) >= self.most_chunks:
            known.clear()
        run, ends = laid_out(coded.dictionary)
        run, ends = run.tobytes(), ends.tolist()
        distinct = [run[a:b] for a, b in zip(ends, ends[1:])]
        learn([u for u in distinct if u not in known])
        return [known[u] for u in distinct], np.asarray(coded.indices), bounds

    def encode(self, text: str) -> bytes:
        known, chunks = self.chunks, text.replace("\n", " ").split(" ")
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) >= self.most_chunks:
                known.clear()
            for c in set(chunks).difference(known):
                known[c] = self.chunk(c)
            return b"".join([known[c] for c in chunks])


def encoder(path: str, chunks: int = CHUNKS, words: int = WORDS) -> ChunkEncoder:
    """The worker's encoder; memos of fewer entries trade time for memory."""
    return common.keep(("encoder", path, chunks, words), lambda: ChunkEncoder(path, chunks, words))


def encode_ids(documents: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, width): every whole text as little-endian ids of ``width`` bytes, the end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(tokenizer_path)
        for batch in slices(batches, "text", SLICE):
            ids, bounds = memo.encode_all(*flat(batch), end_id)
            ends = (bounds * memo.type.itemsize).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(np.full(len(ids), memo.type.itemsize, np.int32))], ["doc_id", "ids", "width"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(encode), "doc_id long, ids binary, width int")


def token_counts(documents: DataFrame, tokenizer_path: str, keep: list[str] | None = None, chunks: int = CHUNKS, words: int = WORDS) -> DataFrame:
    """doc_id, the ``keep`` columns and n_tokens, without an end id."""
    keep = ["doc_id", *(keep or [])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(tokenizer_path, chunks, words)
        for batch in slices(batches, "_text", SLICE):
            counts = memo.count_all(*flat(batch, "_text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts)], [*keep, "n_tokens"])

    rows = documents.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)
    return rows.mapInArrow(tidy(count), f"{kinds}, n_tokens long")


def _train(samples: list[bytes], size: int) -> bytes:
    """A dictionary from samples; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionary(ids: DataFrame, size: int = 32 << 10, fan_in: int = 32, chunk: int = 8 << 20) -> bytes:
    """One dictionary from all documents, trained as a tree.

    Each chunk of documents trains a dictionary; groups of ``fan_in`` dictionaries, cut into samples, train the next
    level until one is left. No task or driver sees more than a chunk or ``fan_in`` dictionaries.
    """
    spark = ids.sparkSession

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([_train(held, size)], pa.binary())], ["dictionary"])
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                held.append(x)
                total += len(x)
                if total >= chunk:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    def merge(key, table):  # applyInArrow wants it without annotations
        samples = [d[i : i + 256] for d in table.column("dictionary").to_pylist() for i in range(0, len(d), 256)]
        return pa.table({"dictionary": pa.array([_train(samples, size)], pa.binary())})

    level = written(ids.select("ids").mapInArrow(leaves, "dictionary binary"), "dictionaries")
    n = level.count()
    while n > 1:
        groups = -(-n // fan_in)
        level = level.groupBy(F.pmod(F.xxhash64("dictionary"), F.lit(groups)).alias("g")).applyInArrow(merge, "dictionary binary")
        level = written(level, "dictionaries")
        n = level.count() if groups > 1 else 1
    return bytes((level.first() or [b""])[0])


def write_store(ids: DataFrame, path: str, dictionary: bytes, block_bytes: int = 1 << 20, partitions: int | None = None, level: int = 3) -> None:
    """Write (doc_id, ids, width) as a store: a range shuffle by document, then one pass that compresses in order."""
    spark = ids.sparkSession
    digest = hashlib.sha256(dictionary).hexdigest()
    names = ["first_doc_id", "last_doc_id", "start", "n_tokens", "width", "dictionary_sha256", "doc_ids", "offsets", "counts", "frames"]

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=shared, write_dict_id=False)
        docs, offsets, counts, frames, start, width = [], [0], [], [], 0, 2

        def block() -> pa.RecordBatch:
            values = [[docs[0]], [docs[-1]], [start], [sum(counts)], [width], [digest], [docs], [offsets], [counts], [b"".join(frames)]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

        for batch in batches:
            for doc, raw, width in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append(doc)
                counts.append(len(raw) // width)
                frames.append(zip_.compress(raw))
                offsets.append(offsets[-1] + len(frames[-1]))
                if offsets[-1] >= block_bytes:
                    yield block()
                    start += sum(counts)
                    docs, offsets, counts, frames = [], [0], [], []
        if docs:
            yield block()

    ordered = ids.select("doc_id", "ids", "width").repartitionByRange(partitions or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    schema = "first_doc_id long, last_doc_id long, start long, n_tokens long, width int, dictionary_sha256 string, doc_ids array<long>, offsets array<long>, counts array<long>, frames binary"
    blocks = ordered.mapInArrow(compress, schema).withColumn("shard", F.spark_partition_id())
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit, start the ids of all documents before.

    ``doc_ids`` restricts the read to a few documents: blocks are pruned by their id range and only the frames
    asked for are decompressed. A block whose dictionary hash differs from the store's dictionary is an error.
    """
    digest, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, wanted = bytes(dictionary), None if doc_ids is None else set(doc_ids)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))  # one row a partition of the writer
    if wanted is not None:
        hit = F.lit(False)
        for d in wanted:
            hit = hit | ((F.col("first_doc_id") <= d) & (F.col("last_doc_id") >= d))
        blocks = blocks.filter(hit)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unzip = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != digest:
                    raise ValueError(f"block needs dictionary {row['dictionary_sha256']}, the store has {digest}")
                start, frames, kind = row["shard_start"] + row["start"], row["frames"], "<u4" if row["width"] == 4 else "<u2"
                docs, starts, counts, ids = [], [], [], []
                for i, (doc, n) in enumerate(zip(row["doc_ids"], row["counts"])):
                    if wanted is None or doc in wanted:
                        raw = unzip.decompress(frames[row["offsets"][i] : row["offsets"][i + 1]])
                        docs.append(doc)
                        starts.append(start)
                        counts.append(n)
                        ids.append(np.frombuffer(raw, kind).astype("<u4").tobytes())
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(F.broadcast(shards), "shard").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def build(documents: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> str:
    """Encode, train the dictionary and write the store; returns its folder."""
    path = path or f"{tables_dir(documents.sparkSession)}/token-store-{os.urandom(8).hex()}"
    ids = written(encode_ids(documents, tokenizer_path, end_id), "token-ids")
    write_store(ids, path, train_dictionary(ids))
    return path
