"""MinHash near-deduplication with odd sketches.

Each document's set of word shingles gets ``samples`` MinHash values. Runs of them form bands; documents that share
a band are candidates. All samples are folded into an odd sketch, a parity bitmap: the population count of the XOR of
two sketches gives the size of the symmetric difference of the samples and with it the Jaccard similarity, most
precisely where it is high. Candidates whose estimate is within a margin of the threshold are confirmed on full sets.

Equal sets are collapsed first, so a group of exact copies costs one member. A band's bucket gives only a spanning
forest of its candidate pairs; the components of these forests are clusters, and every candidate pair lies within one.
A cluster's texts then meet in tiles that compare their full sets and return spanning links. A cluster of one tile takes
each text once; in a larger one, sketches meet in the tiles first, and a tile takes the texts of those members alone
that have a candidate in it. So no pair is emitted beyond a forest, and none is lost. Sets are of 64-bit hashes of the
shingles: two different shingles of a pair of texts are taken for one with a chance of about 1e-12.

Ties and repeats: rows that share a doc_id are one node. A null doc_id is linked with nothing (component null, kept).
Null or word-free text has an empty set and is linked with nothing. Empty tables give empty results. Further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import tiles
from marketlens.llm.common import fixed, keep, mix, packed, parted, runs, slices, tidy, written
from marketlens.llm.graph import components

U = np.uint64
BITS = 1024  # of an odd sketch
ROWS = 5  # MinHash values in a band, fewer for low thresholds
SAMPLES = 256
MISS = 1e-6  # chance that a pair at the threshold shares no band
BLOCK_SHINGLES = 1 << 21  # of the sets that a block of a cluster holds
MARGIN = 5.0  # standard deviations of the estimate below the threshold that are still confirmed


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())

    def powers(b: int) -> np.ndarray:
        steps = np.full(size, b, U)
        steps[0] = 1
        return np.cumprod(steps, dtype=U)

    base = 0x9E3779B97F4A7C15
    held = keep(("powers",), dict)
    if len(held.get("up", ())) < size:  # longer ones serve shorter texts too
        held.update(up=powers(base), down=powers(pow(base, -1, 1 << 64)))
    return held["up"], held["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many each text has. A-Z are lower-cased."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    if not len(data):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(data))
    total = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)])
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(U))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(first, ends, "left"), prepend=0)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; fewer words make one shingle, none an empty set."""
    hashes, counts = word_hashes(texts)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(hashes) - words + 1), U)
        for k in range(words):
            acc = mix(acc * U(0x2545F4914F6CDD1D) + hashes[k : k + len(acc)])
        out, at = [], 0
        for n in counts.tolist():
            if n >= words:
                out.append(np.unique(acc[at : at + n - words + 1]))
            elif n:
                h = np.full(1, n, U)
                for k in range(n):
                    h = mix(h * U(0x2545F4914F6CDD1D) + hashes[at + k : at + k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, U))
            at += n
    return out


def shape(threshold: float) -> tuple[int, int]:
    """(bands, rows): as many rows a band, up to ROWS, as leave the samples for enough bands."""
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows))
        if bands * rows <= SAMPLES:
            break
    return bands, rows


def least_estimate(threshold: float) -> float:
    return threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / SAMPLES)


def sketch(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, bands) and odd sketches (n, BITS / 8) of non-empty sets."""
    seed = np.random.default_rng(7)
    flips, factors = seed.integers(0, 1 << 32, SAMPLES, dtype=np.uint32), seed.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    every = np.concatenate(sets)
    low = (every ^ (every >> U(32))).astype(np.uint32)
    least, work = np.empty((len(sets), SAMPLES), np.uint32), np.empty_like(low)
    for i in range(SAMPLES):
        np.multiply(np.bitwise_xor(low, flips[i], out=work), factors[i], out=work)
        least[:, i] = np.minimum.reduceat(work, starts)
    with np.errstate(over="ignore"):
        keys = np.zeros((len(sets), bands), U) + mix(np.arange(1, bands + 1).astype(U))
        for r in range(rows):
            keys = mix(keys * U(0x9E3779B97F4A7C15) + least[:, r : bands * rows : rows].astype(U))
        place = mix(least.astype(U) + (np.arange(SAMPLES).astype(U) << U(32))) % U(BITS)
    flat = (place.astype(np.int64) + np.arange(len(sets))[:, None] * BITS).ravel()
    odd = (np.bincount(flat, minlength=len(sets) * BITS) & 1).astype(np.uint8)
    return keys, np.packbits(odd.reshape(len(sets), BITS), axis=1)


def _sums(sets: list[np.ndarray], at: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums, modulo 2**64, of the mixed hashes of each non-empty set, at its place among n; 0 for the others."""
    out = np.zeros((2, n), U)
    if sets:
        every, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
        for k, flip in enumerate((U(0), U(0xA5A5A5A5A5A5A5A5))):
            out[k, at] = np.add.reduceat(mix(every ^ flip), starts)
    return tuple(out.view(np.int64))


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, given as (n, BITS / 64) words and broadcast against each other."""
    differing = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    table = np.arange(BITS + 1)
    apart = -BITS / 2 * np.log(np.maximum(1 - 2 * table / BITS, 1e-9))
    return (1 - apart / (2 * SAMPLES))[differing]


def signatures(documents: DataFrame, words: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands, sketch): s1 and s2 identify the set."""
    bands, height = shape(threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], words)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, odd = sketch([sets[i] for i in some], bands, height) if some else (np.zeros((0, bands), U), np.zeros((0, BITS // 8), np.uint8))
            all_keys, all_odd = np.zeros((len(sets), bands), U), np.zeros((len(sets), BITS // 8), np.uint8)
            all_keys[some], all_odd[some] = keys, odd
            s1, s2 = _sums([sets[i] for i in some], some, len(sets))
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(all_keys.view(np.int64).ravel()))
            counts = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(s1), pa.array(s2), lists, packed(all_odd)], ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary")


def _columns(batch: pa.RecordBatch, plain: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {k: np.asarray(batch.column(k)) for k in plain} | {"sketch": fixed(batch.column("sketch"), BITS // 8).copy().view(U)}


def _candidates(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs from x and y whose estimate and sizes allow the threshold, a block of x at a time."""
    for at in range(0, len(x) if len(y) else 0, 128):
        part = x[at : at + 128]
        est = estimates(c["sketch"][part][:, None, :], c["sketch"][y][None, :, :])
        small, large = np.minimum.outer(c["n_shingles"][part], c["n_shingles"][y]), np.maximum.outer(c["n_shingles"][part], c["n_shingles"][y])
        i, j = np.nonzero((est >= floor) & (small >= threshold * large - 1e-9) & (part[:, None] != y[None, :]))
        yield part[i], y[j]


def _forest(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that span the candidate pairs of each band's members, in tiles (key, lo, hi, block, member, n_shingles, sketch)."""
    floor = least_estimate(threshold)

    def load(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return _columns(batch, ("key", "lo", "hi", "block", "member", "n_shingles"))

    def tile(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, y = tiles.sides(c["block"], int(c["lo"][0]), int(c["hi"][0]))
        found = list(_candidates(c, x, y, threshold, floor))
        if not found:  # all members are of the other block
            return c["member"][:0], c["member"][:0]
        a, b = (np.concatenate(z) for z in zip(*found))
        root = tiles.spanning(len(c["member"]), a, b)
        some = np.flatnonzero(root != np.arange(len(root)))
        return c["member"][some], c["member"][root[some]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in runs(batches, ["key", "lo", "hi"], load):
            out = [tile({k: v[s:e] for k, v in cols.items()}) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if e - s > 1]
            if out:
                a, b = (np.concatenate(z) for z in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiles.sorted_tiles(rows).mapInArrow(tidy(work), "a long, b long").distinct()


def _alike(rows: DataFrame, threshold: float) -> DataFrame:
    """Of the members in tiles (key, lo, hi, block, member, n_shingles, sketch): those with a candidate in the tile."""
    floor = least_estimate(threshold)

    def load(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return _columns(batch, ("key", "lo", "hi", "block", "member", "n_shingles"))

    def tile(c: dict[str, np.ndarray]) -> np.ndarray:
        x, y = tiles.sides(c["block"], int(c["lo"][0]), int(c["hi"][0]))
        some = np.zeros(len(c["member"]), bool)
        for i, j in _candidates(c, x, y, threshold, floor):
            some[i] = some[j] = True
        return some

    names = ["key", "lo", "hi", "block", "member"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in runs(batches, ["key", "lo", "hi"], load):
            some = np.concatenate([tile({k: v[s:e] for k, v in cols.items()}) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(cols[k][some]) for k in names], names)

    return tiles.sorted_tiles(rows).mapInArrow(tidy(work), "key long, lo int, hi int, block int, member long")


def linked_sets(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a from x, b from y) of the pairs of sets whose Jaccard similarity reaches the threshold, in whole numbers.

    Shingles of one set alone can't be shared and are left out; the others are columns of a bit matrix, and a pair's
    intersection is the population count of the AND of its rows.
    """
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yes = both > 0 and 100 * both >= hundredths * (int(sizes.sum()) - both)
        return (np.array([0]), np.array([1])) if yes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    common = np.zeros((len(x), len(y)), np.int32)
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        place = column[lo:hi] - at
        bits = np.bincount(owner[lo:hi] * (width // 8) + place // 8, 1 << (place % 8), len(sets) * (width // 8)).astype(np.uint8)
        used = -(-(int(place.max()) + 1) // 64)  # words that hold anything
        rows = np.ascontiguousarray(bits.reshape(len(sets), -1)).view(U)[:, :used]
        step = max(1, (1 << 21) // max(1, used * len(y)))
        for k in range(0, len(x), step):
            common[k : k + step] += np.bitwise_count(rows[x[k : k + step]][:, None, :] & rows[y][None, :, :]).sum(axis=2, dtype=np.int32)
    i, j = np.nonzero((common > 0) & (100 * common.astype(np.int64) >= hundredths * (sizes[x][:, None] + sizes[y][None, :] - common)) & (x[:, None] != y[None, :]))
    return x[i], y[j]


def _confirmed(clusters: DataFrame, sketches: DataFrame, documents: DataFrame, words: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that span the confirmed pairs within each cluster (member, cluster, n_shingles)."""
    hundredths = round(threshold * 100)

    def load(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        cols = {k: np.asarray(batch.column(k)) for k in ("key", "lo", "hi", "block", "member")}
        sets = np.empty(batch.num_rows, object)
        sets[:] = shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], words)
        return cols | {"set": sets}

    def tile(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, y = tiles.sides(c["block"], int(c["lo"][0]), int(c["hi"][0]))
        a, b = linked_sets(list(c["set"]), x, y, hundredths)
        root = tiles.spanning(len(c["member"]), a, b)
        some = np.flatnonzero(root != np.arange(len(root)))
        return c["member"][some], c["member"][root[some]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in runs(slices(batches, "text", 1 << 20), ["key", "lo", "hi"], load):
            out = [tile({k: v[s:e] for k, v in cols.items()}) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if e - s > 1]
            if out:
                a, b = (np.concatenate(z) for z in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    texts = documents.select(F.col(id_col).cast("long").alias("member"), F.col(text_col).alias("text"))
    blocks = written(tiles.dealt(clusters, "cluster", "member", weight="n_shingles", weight_limit=BLOCK_SHINGLES), "cluster-blocks")
    place = ["key", "lo", "hi", "block", "member"]
    large = blocks.filter("blocks > 1").join(sketches.drop("n_shingles"), "member")
    placed = written(blocks.filter("blocks = 1").select(*place).unionByName(_alike(large, threshold)), "cluster-members")
    texts, _ = parted(texts, placed, "member")  # so that texts without a candidate aren't shuffled
    return tiles.sorted_tiles(texts.join(placed.hint("merge"), "member")).mapInArrow(tidy(work), "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document."""
    marks = written(signatures(documents, words, threshold, id_col, text_col), "signatures")
    some = marks.filter("n_shingles > 0 and doc_id is not null")
    alike = ["s1", "s2", "n_shingles"]
    classes = written(some.groupBy(*alike).agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.select(*alike, F.col("rep").alias("doc_id")), [*alike, "doc_id"], "left_semi").dropDuplicates([*alike, "doc_id"])
    reps = written(reps.select(F.col("doc_id").alias("member"), "n_shingles", "bands", "sketch"), "representatives")

    facts = reps.select("member", "n_shingles", "sketch")
    bands = tiles.dealt(reps.select("member", F.explode("bands").alias("band")), "band", "member")  # narrow; sketches join the tiles
    linked = components(written(_forest(bands.join(facts, "member"), threshold), "forest"))
    clusters = linked.select(F.col("id").alias("member"), F.col("component").alias("cluster")).join(facts.select("member", "n_shingles"), "member")
    links = written(_confirmed(clusters, facts, documents, words, threshold, id_col, text_col), "links")

    # representatives of different sets that share a doc_id are one node already; so are the copies of a set
    final = components(links.unionByName(_same_node(some, classes, alike)))
    out = marks.join(classes, alike, "left").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    home = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", home.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_node(some: DataFrame, classes: DataFrame, alike: list[str]) -> DataFrame:
    """Links between the classes of rows that share a doc_id (none in a table whose ids are unique)."""
    several = some.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    return some.join(several, "doc_id", "left_semi").join(classes, alike).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
