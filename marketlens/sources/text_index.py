"""A trigram index of the texts of a table with a commit log: it tells which files can hold a substring.

For each data file the index marks the hashes of all runs of three bytes of its lower-cased texts in a bitmap of
``BITS`` bits, kept as rows of 64. A substring can only stand in files whose bitmap has all of its own trigrams, so a search reads
those alone and filters them as before: the index leaves files out, it never decides a match. Files are never changed
once they are written, so an update looks at new files only; files that the index doesn't know are always read.
Substrings of less than three bytes have no trigram, and all files are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources import commits

BITS = 1 << 18
_HOME = f"/{commits.DATA}/"
_PIECE = 1 << 22  # bytes of text that are hashed at once


def buckets(data: bytes) -> np.ndarray:
    """The distinct places in the bitmap of a text's trigrams."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    grams = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)
    with np.errstate(over="ignore"):
        return np.unique((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _marks(files: list[str], places: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (file, word, bits) of bitmaps given as places."""
    names, words, bits = [], [], []
    for file, at in zip(files, places):
        word, start = np.unique(at // 64, return_index=True)
        names += [file] * len(word)
        words.append(word)
        bits.append(np.bitwise_or.reduceat(np.uint64(1) << (at % 64).astype(np.uint64), start) if len(at) else np.zeros(0, np.uint64))
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([empty, *words]), pa.int64()), pa.array(np.concatenate([empty.astype(np.uint64), *bits]).view(np.int64))], ["file", "word", "bits"])


def bitmaps(rows: DataFrame, column: str) -> DataFrame:
    """(file, word, bits) of the texts of a table that is read from files; bitmaps are united by file before the shuffle and behind it."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grouped: dict[str, list[np.ndarray]] = {}
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                pieces = [buckets((text or b"")[a : a + _PIECE + 2]) for a in range(0, len(text or b""), _PIECE)]
                grouped.setdefault(file, []).extend(pieces)
            yield _marks(list(grouped), [np.unique(np.concatenate([np.zeros(0, np.int64), *p])) for p in grouped.values()])

    texts = rows.select(F.substring_index("_metadata.file_path", _HOME, -1).alias("file"), F.lower(column).alias("text"))
    found = texts.mapInArrow(work, "file string, word long, bits long")
    return found.groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))


def _files(spark: SparkSession, path: str) -> dict[str, str]:
    """The data files of the newest version: name within the table (as Spark writes it in a URI) and path."""
    m = commits.manifest(spark, path)
    uris = [] if m is None or not m.folders else commits.read(spark, path).inputFiles()
    return {u.split(_HOME)[-1]: unquote(u) for u in uris}


def update(spark: SparkSession, path: str, index: str, column: str) -> int:
    """Take the table's new files into the index and leave out those that are gone; how many were taken in."""
    files = _files(spark, path)
    now = set(files)
    old = commits.read(spark, index) if commits.exists(spark, index) else None
    known = set() if old is None else {r.file for r in old.select("file").distinct().collect()}
    new = sorted(now - known)
    if not new and known <= now:
        return 0
    parts = [] if old is None else [old.filter(F.col("file").isin(list(known & now)))]
    if new:
        marks = bitmaps(commits.read_files(spark, path, [files[f] for f in new]), column)
        # a file without any trigram is known all the same
        parts.append(marks.unionByName(spark.createDataFrame([(f, -1, 0) for f in new], "file string, word long, bits long")))
    state = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    commits.replace(spark, index, state, None, "word")
    return len(new)


def candidates(spark: SparkSession, path: str, index: str, q: str) -> DataFrame:
    """The rows of the files that may hold ``q`` in lower case, and of those that the index doesn't know."""
    m, files = commits.manifest(spark, path), _files(spark, path)
    lowered = spark.range(1).select(F.lower(F.lit(q))).first()[0]
    at = buckets(lowered.encode())
    if not files or not len(at) or not commits.exists(spark, index):
        return commits.read(spark, path)
    want = _marks(["q"], [at]).to_pydict()
    marks = commits.read(spark, index)
    known = {r.file for r in marks.select("file").distinct().collect()}
    asked = spark.createDataFrame(list(zip(want["word"], want["bits"])), "word long, want long")
    hit = marks.join(F.broadcast(asked), "word").filter(F.col("bits").bitwiseAND(F.col("want")) == F.col("want")).groupBy("file").agg(F.count("*").alias("n"))
    may = {r.file for r in hit.filter(F.col("n") == len(want["word"])).collect()}
    chosen = [files[f] for f in files if f in may or f not in known]
    return commits.read_files(spark, path, chosen) if chosen else spark.createDataFrame([], m.schema)
