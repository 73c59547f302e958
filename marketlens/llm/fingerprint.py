"""Document fingerprints: a homomorphic hash of a text's multiset of paragraphs.

A paragraph (a line that isn't empty; empty lines are dropped, so texts that differ in them alone are equal) hashes to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors. So the
order of paragraphs doesn't matter, and inserting or deleting a paragraph adds or subtracts its vector. The vector has
two parts. ``STRONG`` lanes modulo 2**32 come from a cryptographic hash and decide equality. ``NEAR`` lanes modulo
2**64 are a signed count sketch of the paragraph's windows of eight bytes; as sums are linear, the angle between two
such parts estimates how much of two texts is alike.

A null text counts as empty: its fingerprint is zero, and its likeness to another empty text 1. Fingerprints are given
in lowercase hex, little-endian, the strong part first. Rows that share an id follow each other in the order of their
texts. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import shuffle_partitions, slices

STRONG, NEAR, WINDOW = 16, 128, 8
_GAP = b"\0" * (WINDOW - 1)


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(strong, near) of a text."""
    paragraphs = [p for p in text.split(b"\n") if p]
    if not paragraphs:
        return np.zeros(STRONG, np.uint32), np.zeros(NEAR, np.uint64)
    digests = b"".join([hashlib.blake2b(p, digest_size=4 * STRONG).digest() for p in paragraphs])
    strong = np.frombuffer(digests, "<u4").reshape(-1, STRONG).sum(axis=0, dtype=np.uint32)
    data = np.frombuffer(_GAP + _GAP.join(paragraphs) + _GAP, np.uint8)  # no window reaches from one paragraph into the next
    windows = np.lib.stride_tricks.as_strided(data[:WINDOW].view("<u8"), (len(data) - WINDOW + 1,), (1,))
    with np.errstate(over="ignore"):
        x = windows * np.uint64(0x9E3779B97F4A7C15)
        x = ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)
    signed = np.bincount(x.astype(np.int64), minlength=2 * NEAR)
    return strong, (signed[:NEAR] - signed[NEAR:]).astype(np.uint64)


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint with b's paragraphs inserted (sign 1) or deleted (sign -1)."""
    if sign > 0:
        return a[0] + b[0], a[1] + b[1]
    return a[0] - b[0], a[1] - b[1]


def text_of(v: tuple[np.ndarray, np.ndarray]) -> str:
    return (v[0].astype("<u4").tobytes() + v[1].astype("<u8").tobytes()).hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].view(np.int64).astype(float), b[1].view(np.int64).astype(float)
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(max(x @ y / size, 0.0), 1.0)) if size else 0.0


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [text_of(vector(t or b"")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fingerprint string")


def _bounds(spark: SparkSession, documents: DataFrame, parts: int) -> list[int]:
    """Up to ``parts`` - 1 ids that cut the documents into ranges of about equally many rows; null ids are all in the first range."""
    got = documents.filter("doc_id is not null").select(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100 * parts)).alias("q")).first() if parts > 1 else None
    return sorted(set(got.q)) if got and got.q else []


def compare_edits(documents: DataFrame, part: float = 0.25, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text ends with the beginning of the next document (in the order of ids, the first after the last) in
    place of its last floor(n_chars * part) code points. Documents are dealt to ranges of ids; the first document of a
    range also goes to the range before it, so that each range can be worked through alone, in order.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _bounds(spark, rows, parts or shuffle_partitions(spark))

    @F.pandas_udf("int")
    def place(ids):
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), ids.fillna(-(1 << 63)).to_numpy(np.int64), "right"), dtype="int32")

    rows = rows.withColumn("place", place("doc_id"))
    last = len(cuts)
    # the first row of each range, by id and text: a few bytes a range
    firsts = rows.groupBy("place").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("h"))).alias("first"))
    firsts = {r.place: (r.first.i, r.first.h) for r in firsts.collect()}
    order = sorted(firsts)
    before = {p: order[k - 1] for k, p in enumerate(order)}  # the first range follows the last
    marks = [(p, i, h, before[p]) for p, (i, h) in firsts.items()]
    lead = spark.createDataFrame(marks, "place int, i long, h long, target int") if marks else spark.createDataFrame([], "place int, i long, h long, target int")
    rows = rows.withColumn("i", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    goes = F.when(F.col("target").isNotNull(), F.array(F.struct(F.col("place").alias("to"), F.lit(0).alias("sentinel")), F.struct(F.col("target").alias("to"), F.lit(1).alias("sentinel")))).otherwise(F.array(F.struct(F.col("place").alias("to"), F.lit(0).alias("sentinel"))))
    sent = rows.join(F.broadcast(lead), ["place", "i", "h"], "left").select("doc_id", "text", "i", "h", F.explode(goes).alias("g"))
    sent = sent.select("doc_id", "text", "i", "h", "g.to", "g.sentinel")
    # of rows that are equal in id and text, one is enough to lead
    dealt = sent.repartitionByRange(last + 1, "to").sortWithinPartitions("to", "sentinel", "i", "h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # the row whose successor is to come

        def finish(row, nxt) -> tuple:
            doc, text, v = row
            n = len(text)
            k = int(n * part)
            edited = (text[: n - k] + nxt[1][:k]).encode()
            e = vector(edited)
            return doc, n, hashlib.sha256(edited).hexdigest(), text_of(v), text_of(e), likeness(v, e), likeness(v, nxt[2])

        at = None
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for doc, text, to, sentinel in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "to", "sentinel"))):
                if held is not None and to == at:
                    row = (doc, text, vector(text.encode()))
                    out.append(finish(held, row))
                else:
                    row = (doc, text, vector(text.encode()))
                at, held = to, None if sentinel else row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(work, schema)
