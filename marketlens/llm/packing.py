"""Conflict-constrained best-fit packing of documents into windows of tokens.

Pieces are placed in order of falling length, each into the open bin with the least room that still holds it and that
it doesn't conflict with. Bins stand in the order of their residual room. A bin carries two bitmaps: one of the sources
that have used up their quota in it, one of the duplicate clusters it holds. The search starts at the tightest bin and
goes on to its successors until a compatible one is found; if none is, a bin is opened. Pieces of the same cluster and
length are placed in one walk, since a bin takes at most one of them.

Documents longer than a window are cut into full windows and a rest; no token is dropped. Documents are dealt to shards
of about ``SHARD`` by a hash of their id, and a shard is packed alone, so work and memory are bounded, and what is lost
is a few half-empty bins a shard.

A null or empty text has no tokens and gets a row without a bin. Null sources conflict with nothing, and null clusters
neither. Ties go by doc_id, then by piece. Repeated rows are packed as often as they come. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096  # tokens of a window
QUOTA = 4  # documents of one source in a bin
SHARD = 8192  # documents packed together


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, quota: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces come in falling length with equal clusters together; -1: no source or cluster."""
    order: list[tuple[int, int]] = []  # (residual room, bin), sorted
    full: list[int] = []  # bitmap of each bin: sources at their quota
    held: list[int] = []  # bitmap of each bin: clusters
    used: list[dict[int, int]] = []
    out: list[tuple[int, int]] = []
    i, n = 0, len(lengths)
    while i < n:
        size, cluster, j = lengths[i], clusters[i], i + 1
        while cluster >= 0 and j < n and clusters[j] == cluster and lengths[j] == size:
            j += 1
        at = bisect_left(order, (size, -1))
        bit = 1 << cluster if cluster >= 0 else 0
        moved: list[tuple[int, int]] = []
        waiting = list(range(i, j))
        placed: dict[int, tuple[int, int]] = {}
        while waiting and at < len(order):
            room, b = order[at]
            k = next((k for k in waiting if sources[k] < 0 or not full[b] >> sources[k] & 1), None) if not held[b] & bit else None
            if k is None:
                at += 1
                continue
            waiting.remove(k)
            del order[at]
            placed[k] = (b, capacity - room)
            moved.append((room - size, b))
            _take(b, sources[k], bit, full, held, used, quota)
        for k in waiting:
            b = len(full)
            full.append(0)
            held.append(0)
            used.append({})
            placed[k] = (b, 0)
            moved.append((capacity - size, b))
            _take(b, sources[k], bit, full, held, used, quota)
        for room, b in moved:
            if room:
                insort(order, (room, b))
        out += [placed[k] for k in range(i, j)]
        i = j
    return out


def _take(b: int, source: int, bit: int, full: list[int], held: list[int], used: list[dict[int, int]], quota: int) -> None:
    held[b] |= bit
    if source >= 0:
        used[b][source] = used[b].get(source, 0) + 1
        if used[b][source] >= quota:
            full[b] |= 1 << source


def pack(documents: DataFrame, capacity: int = CAPACITY, quota: int = QUOTA, shard: int = SHARD, rows: int | None = None) -> DataFrame:
    """(doc_id, source, cluster, piece, piece_tokens, bin_id, bin_offset) from (doc_id, source, cluster, n_tokens)."""
    rows = documents.count() if rows is None else rows
    shards = max(1, -(-rows // shard))
    names = ["doc_id", "source", "cluster", "piece", "piece_tokens", "bin_id", "bin_offset"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]

    def one(number: int, table: pa.Table) -> pa.RecordBatch:
        docs, sources, clusters, counts = (table.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n_tokens"))
        source_ids: dict = {}
        cluster_sizes: dict = {}
        for c in clusters:
            cluster_sizes[c] = cluster_sizes.get(c, 0) + 1
        cluster_ids: dict = {}
        pieces, empty = [], []
        for d, s, c, n in zip(docs, sources, clusters, counts):
            if not n:
                empty.append((d, s, c, 0, 0, None, None))
                continue
            si = -1 if s is None else source_ids.setdefault(s, len(source_ids))
            # only clusters of several documents here can conflict
            ci = -1 if c is None or cluster_sizes[c] < 2 else cluster_ids.setdefault(c, len(cluster_ids))
            for k, start in enumerate(range(0, n, capacity)):
                pieces.append((-min(capacity, n - start), ci, d is not None, d or 0, k, d, s, c, si))
        pieces.sort(key=lambda p: (p[:5], str(p[6]), p[7] or 0))
        places = best_fit([-p[0] for p in pieces], [p[8] for p in pieces], [p[1] for p in pieces], capacity, quota)
        rows = [(p[5], p[6], p[7], p[4], -p[0], f"{number}-{b}", at) for p, (b, at) in zip(pieces, places)] + empty
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if b <= a:
                    continue
                if held and held[0].column("shard")[0].as_py() != number[a]:
                    yield one(held[0].column("shard")[0].as_py(), pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield one(held[0].column("shard")[0].as_py(), pa.Table.from_batches(held))

    dealt = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("long"), F.col("n_tokens").cast("long"))
    # the whole row is hashed, so that even rows that share an id spread
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "n_tokens"), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionByRange("shard").sortWithinPartitions("shard")  # few numbers, which a hash would spread unevenly
    return dealt.mapInArrow(work, "doc_id long, source string, cluster long, piece int, piece_tokens long, bin_id string, bin_offset long")
