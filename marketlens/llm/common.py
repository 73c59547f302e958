"""Shared helpers of the text operators: scratch tables, held-out folds and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.scratch import scratch_dir, written  # noqa: F401  for the operators


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def aside(documents: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work``, a filter or rewrite of documents, with columns it doesn't know under names that can't clash with its own."""
    columns = documents.columns
    named = documents.toDF(*(c if c in KNOWN else f"_extra_{i}" for i, c in enumerate(columns)))
    return work(named).select(*named.columns).toDF(*columns)


def fold(key: str, mod: int) -> Column:
    """crc32 of the key's decimal text, modulo ``mod``: the fold that decides what is held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        if not len(sizes):
            continue
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def flat(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch as one run of UTF-8 bytes, null as empty, with the n + 1 offsets that bound them."""
    return laid_out(pc.fill_null(batch.column(column).cast(pa.binary()), b""))


def laid_out(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Binary values without nulls as ``flat`` gives them."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z alone lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte whether it lies in one of the ranges, bounds included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes that are inside, none of which crosses the bounds of a text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True  # at the bounds of texts
    before = np.append(False, inside[:-1]) & ~first[:-1]
    after = np.append(inside[1:], False) & ~first[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def keys_at(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The (up to eight) bytes of ``data`` at each position as a number that sorts as they do; ``left``: how many count.

    ``data`` ends in eight bytes of padding at least.
    """
    windows = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    keep = np.clip(left, 0, 8)
    mask = np.append(np.uint64(0), ~np.uint64(0) << (np.arange(7, -1, -1, dtype=np.uint64) * np.uint64(8)))
    return windows[np.minimum(at, len(data) - 8)].byteswap() & mask[keep]


def release() -> None:
    """Give the memory that this worker has freed back to the system, as idle workers live on beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


_kept: dict[tuple, Any] = {}


def keep(key: tuple, make: Callable[[], Any]) -> Any:
    """What this worker keeps from task to task, of one operator at a time: another one's is dropped before ``make`` is called."""
    if key not in _kept:
        _kept.clear()
        release()
        _kept[key] = make()
    return _kept[key]


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after whose end the worker gives back what it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def fixed(array: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a (rows, width) array."""
    n = len(array)
    if not n:
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + n + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, width)


def packed(rows: np.ndarray) -> pa.Array:
    """The reverse of ``fixed``."""
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


MOST_WORDS = 1 << 22  # of 64 bits: 64 MB to broadcast at most


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` as (those whose key may be among ``ids``, a written table; those whose key certainly isn't).

    The ids are marked in a bitmap of 16 bits an id, up to ``MOST_WORDS``, that is summed by Spark and broadcast as rows of
    64 bits. So a join of wide rows with few ids shuffles the rows of the first part alone. Beyond that size more rows
    fall in the first part; none that belongs there is ever missed. Null keys are in the second.
    """
    words = min(MOST_WORDS, max(1 << 10, 1 << (ids.count() // 4).bit_length()))

    def marked(df: DataFrame) -> DataFrame:
        spot = F.xxhash64(F.col(key), F.lit(29))
        bit = F.when(F.col(key).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), (spot.bitwiseAND(F.lit(63))).cast("int")))
        return df.withColumn("_word", F.pmod(F.shiftrightunsigned(spot, 6), F.lit(words).cast("long"))).withColumn("_bit", bit)

    bitmap = marked(ids.select(key)).filter("_bit is not null").groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    bitmap = F.broadcast(written(bitmap, "bitmap"))
    left, right = marked(rows).alias("l"), bitmap.alias("r")
    here = (F.col("l._word") == F.col("r._word")) & (F.col("l._bit").bitwiseAND(F.col("r._bits")) != 0)
    return tuple(left.join(right, here, kind).drop("_word", "_bit") for kind in ("left_semi", "left_anti"))


Columns = dict[str, np.ndarray]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], load: Callable[[pa.RecordBatch], Columns]) -> Iterator[tuple[Columns, np.ndarray]]:
    """From batches sorted by ``keys``: columns with the bounds of their complete runs of equal keys.

    A run that spans batches is put together; the caller bounds how long a run can be.
    """
    held: Columns | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = load(batch)
        if held is not None:
            cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
        n = len(cols[keys[0]])
        change = np.zeros(n, bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(change)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield {k: v[:last] for k, v in cols.items()}, np.concatenate([[0], starts])
        held = {k: v[last:] for k, v in cols.items()}
    if held is not None and len(held[keys[0]]):
        yield held, np.array([0, len(held[keys[0]])])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
