"""Language-model scoring by context-tree weighting over bytes.

A text is all its bytes, A-Z lower-cased, and one end sign. Every byte is coded as eight binary decisions. The contexts of
a decision are the bits of its byte so far together with the last 0, 1, ... ``DEPTH`` bytes, across words and lines. A
node of the context tree counts the zeros and ones it saw in training; its Krichevsky-Trofimov estimate is mixed with the
product of its children's weighted probabilities, half and half, from the deepest contexts up to the root. That gives
every node the posterior weight of stopping there, and a decision's probability mixes the estimates on its path by these
weights: an unseen context contributes one half. The negative logarithm is the text's code length, also given per byte.

Texts are gathered into chunks, and a chunk asks about each of its distinct grams (a byte with its context) and words
once, however often they occur:

1. A task reads documents into chunks of about ``CHUNK`` bytes and writes each chunk's texts, and its distinct grams and
   words with their training counts, dealt to buckets by hash.
2. Buckets sum the counts. The grams go on to subtrees (contexts that end in the same two bytes), each whole in one task.
   A subtree of more than ``LIMIT`` grams is split by the next byte of context, and again, until none is too large. The
   nodes above the subtrees are folded by the driver and go to all tasks: at most 65,280 nodes above those of two
   bytes, and 255 for each one split, of which there are at most ``SPLITS`` at each number of bytes.
3. Subtrees give each distinct gram its log probability, which goes back to the bucket.
4. Buckets answer the chunks, and a chunk scores its texts from the answers.

So what is shuffled are the distinct grams of chunks, packed into a few bytes each, never positions, and no table of
grams or words is gathered whole; of words, a task holds those of a bucket, and as many of the chunks'. An answer is a whole number of 2**-32, so a byte's log probability is exact to 1e-10.

A null text counts as empty: one end sign. A null doc_id is trained on (its fold is null, so it isn't held out) and is
kept. Rows that share a doc_id are scored alone. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import mix, release, shuffle_partitions, slices, texts, written

DEPTH = 6  # bytes of context; with its byte a gram fits 64 bits
CHUNK = 64 << 20  # bytes of text that ask together
BLOCK = 1 << 20  # bytes of text worked on at a time
TOP = 2  # subtrees are built whole below their last two bytes of context, or more where they are large
UNIT = 1 << 19  # grams of the subtrees built at a time
LIMIT = 1 << 21  # grams of a subtree, at least, that is split
SPLITS = 1 << 14  # subtrees split at each number of bytes, at most
PIECE = 1 << 20  # words of a row
CLOSE = b"\xff"  # before and after a text's bytes; UTF-8 has no such byte
END = "\n"  # stands for the end sign among the words, none of which holds it
GRAM, WORD = 0, 1
FRACTION = 1 << 32  # of an answer's unit
U = np.uint64

Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted codes of nodes, and the one and stop of each


def words_of(some: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in order, A-Z lower-cased, cut at ASCII white space alone, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(some, pa.binary()).cast(pa.string())))
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")  # white space at an end of a text leaves an empty one
    return words.filter(real), np.asarray(owner.filter(real))


def _word_sums(held: list[pa.Table]) -> pa.Table:
    """(word, n): distinct words in order with the sums of their counts."""
    every = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
    return every.select(["word", "n_sum"]).rename_columns(["word", "n"]).sort_by("word")


def _word_table(words: pa.Array, n: np.ndarray) -> pa.Table:
    return pa.table({"word": words, "n": pa.array(n, pa.uint64())})


def _hashes(words: pa.ChunkedArray) -> np.ndarray:
    """Hashes of distinct words, by which they are dealt to buckets."""
    return np.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], U)


def _joined(words: pa.ChunkedArray) -> bytes:
    return zstandard.compress(" ".join(words.to_pylist()).encode(), 1)


def _split(data: bytes) -> pa.Array:
    return pc.list_flatten(pc.split_pattern(pa.array([zstandard.decompress(data).decode()], pa.large_string()), " "))


def _mask(d: int) -> np.uint64:
    """The last d bytes of context in a gram: the latest lies highest, below one empty byte."""
    return U((1 << 56) - (1 << (56 - 8 * d)))


def grams(some: list[bytes], depth: int) -> np.ndarray:
    """All bytes of whole texts and their end signs, each with its context: latest byte highest, the byte itself lowest.

    So the contexts of a node are neighbours where grams are sorted.
    """
    data = np.frombuffer(b"".join([CLOSE * 7 + t.lower() + CLOSE for t in some]), np.uint8)
    windows = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    part = np.repeat(np.arange(len(some)), [len(t) + 1 for t in some])
    windows = windows[np.arange(len(part)) + 7 * part]
    return (windows & _mask(depth)) | windows >> U(56)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, sorted, and the sums of their values; quick where keys come in sorted runs."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *(np.add.reduceat(v[order], starts) for v in values)


Counts = tuple[np.ndarray, np.ndarray]  # sorted keys and their counts


def _merged(held: list[Counts]) -> Counts:
    """The counts as one piece, which takes the place of the others in the list, so that their memory is free meanwhile."""
    if len(held) > 1:
        keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
        held.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        n = n[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(n, starts) if len(starts) < len(keys) else n
        held.append((keys[starts], n))
    return held[0]


def _hold(held: list[Counts], keys: np.ndarray, n: np.ndarray) -> None:
    """Add a piece; all are merged once the later ones outgrow the first."""
    held.append((keys, n))
    if sum(len(k) for k, _ in held[1:]) > max(len(held[0][0]), 1 << 19):
        _merged(held)


def _distinct(keys: np.ndarray) -> Counts:
    keys = np.sort(keys)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    return keys[edges[:-1]], np.diff(edges).astype(U)


def _deflated(numbers: np.ndarray, steps: bool) -> bytes:
    """64-bit numbers as compressed planes of bytes; sorted ones (``steps``) by their differences."""
    numbers = np.diff(numbers, prepend=numbers.dtype.type(0)) if steps else numbers
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _inflated(data: bytes, kind: type, steps: bool) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    numbers = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(numbers, dtype=kind) if steps else numbers


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Grams that differ in their byte and the first byte of their context alone stay together, which packs well."""
    return (mix(keys >> U(16)) % U(n)).astype(np.int64)


def _parts(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, columns) of each bucket, in the order of the rows."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(bucket[a]), [c[order[a:b]] for c in columns]


ASKED = "chunk long, kind int, bucket int, part long, keys binary, counts binary, body binary, ids array<long>, sizes array<long>"
_ASKED = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("body", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def asked(documents: DataFrame, training: Column, depth: int, buckets: int, chunk: int = CHUNK) -> DataFrame:
    """The chunks: their texts (kind null), and their distinct grams and words with training counts by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[Counts] = []
        words: list[pa.Table] = []
        size = part = 0

        def row(**values) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"chunk": number} | values], _ASKED)

        def ask() -> Iterator[pa.RecordBatch]:
            keys, n = _merged(held)
            for bucket, (k, c) in _parts(_bucket(keys, buckets), keys, n):
                yield row(kind=GRAM, bucket=bucket, keys=_deflated(k, True), counts=_deflated(c, False))
            every = _word_sums(words)
            bucket = pa.array(_hashes(every["word"]) % U(buckets))
            for place in pc.unique(bucket).to_pylist():
                mine = every.filter(pc.equal(bucket, place))
                yield row(kind=WORD, bucket=place, keys=_joined(mine["word"]), counts=_deflated(mine["n"].to_numpy(), False))

        for batch in slices(batches, "text", BLOCK):
            some, train = texts(batch), np.array(batch.column("train").to_pylist(), bool)
            yield row(part=part, body=zstandard.compress(b"".join(some), 3), ids=batch.column("doc_id").to_pylist(), sizes=[len(t) for t in some])
            for learns in (True, False):
                mine = [t for t, x in zip(some, train.tolist()) if x == learns]
                if not mine:
                    continue
                keys, n = _distinct(grams(mine, depth))
                _hold(held, keys, n if learns else np.zeros(len(n), U))
                found = pc.value_counts(pa.concat_arrays([words_of(mine)[0], pa.array([END] * len(mine))]))
                words.append(_word_table(found.field("values"), found.field("counts").to_numpy() * learns))
            if sum(w.num_rows for w in words[1:]) > max(words[0].num_rows, 1 << 17):
                words = [_word_sums(words)]
            size, part = size + sum(map(len, some)), part + 1
            if size >= chunk:
                yield from ask()
                number, size, part, held, words = number + 1, 0, 0, [], []
        if held:
            yield from ask()
        held, words = [], []
        release()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(True)).alias("train"))
    return rows.mapInArrow(work, ASKED)


COUNTED = "kind int, bucket int, tree int, keys binary, counts binary, total long, distinct long"


def counted(asks: DataFrame, trees: int) -> DataFrame:
    """Counts summed over the chunks: of grams by (bucket, tree), of words by bucket with their sum in ``total``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[Counts] = []
        words: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = []
            if at is not None and at[0] == GRAM:
                keys, n = _merged(held)
                for tree, (k, c) in _parts(_tree(keys, trees), keys, n):
                    rows.append((GRAM, at[1], tree, _deflated(k, True), _deflated(c, False), 0, 0))
            elif at is not None:
                every = _word_sums(words)
                for k in range(0, every.num_rows, PIECE):
                    some = every.slice(k, PIECE)
                    n = some["n"].to_numpy()
                    rows.append((WORD, at[1], -1, _joined(some["word"]), _deflated(n, False), int(n.sum()), int((n > 0).sum())))
            for k in range(0, len(rows), 256):
                yield _batch(rows[k : k + 256], COUNTED)

        for kind, bucket, keys, counts in _rows(batches, ["kind", "bucket", "keys", "counts"]):
            if at != (kind, bucket):
                yield from done()
                at, held, words = (kind, bucket), [], []
            n = _inflated(counts, U, False)
            if kind == GRAM:
                _hold(held, _inflated(keys, U, True), n)
            else:
                words.append(_word_table(_split(keys), n))
                if sum(w.num_rows for w in words[1:]) > max(words[0].num_rows, 1 << 17):
                    words = [_word_sums(words)]
        yield from done()
        held, words = [], []
        release()

    rows = asks.filter("kind is not null").select("kind", "bucket", "keys", "counts")
    return rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(work, COUNTED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list]:
    """Rows one by one, so that no more than one row's values are held beside their batch."""
    for batch in batches:
        cols = [batch.column(c) for c in columns]
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in cols]


def _tree(keys: np.ndarray, trees: int) -> np.ndarray:
    """The task of each gram's subtree: contexts that end in the same two bytes are together."""
    return (mix(keys >> U(40)) % U(trees)).astype(np.int64)


def _within(keys: np.ndarray, d: int, contexts: np.ndarray) -> np.ndarray:
    """Which grams lie in one of these contexts of d bytes, which are sorted."""
    some = keys & _mask(d)
    return contexts[np.minimum(np.searchsorted(contexts, some), len(contexts) - 1)] == some


def _tops(keys: np.ndarray, large: list[np.ndarray]) -> np.ndarray:
    """How many bytes of context name each gram's subtree: those of the contexts that are split, and one more."""
    top = np.full(len(keys), TOP)
    for d, contexts in enumerate(large, TOP):
        inside = np.flatnonzero(top == d)
        top[inside[_within(keys[inside], d, contexts)]] = d + 1
    return top


def too_large(counts: DataFrame, depth: int) -> list[np.ndarray]:
    """The contexts of TOP, TOP + 1, ... bytes whose subtrees are split, sorted.

    Those of ``depth`` - 1 bytes hold 65,536 grams at most and stay whole.
    """
    rows = counts.filter(f"kind = {GRAM}").select("keys")
    out: list[np.ndarray] = []
    limit = LIMIT
    for d in range(TOP, depth - 1):

        def work(batches: Iterator[pa.RecordBatch], d: int = d, inside: np.ndarray | None = out[-1] if out else None) -> Iterator[pa.RecordBatch]:
            for (packed,) in _rows(batches, ["keys"]):
                keys = _inflated(packed, U, True)
                keys = keys if inside is None else keys[_within(keys, d - 1, inside)]
                contexts, n = _distinct(keys & _mask(d))
                yield _batch([(c, k) for c, k in zip(contexts.view(np.int64).tolist(), n.tolist())], "context long, n long") if len(n) else _NO_SIZES

        sizes = rows.mapInArrow(work, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
        if d == TOP:  # 65,536 rows at most
            found = sizes.toArrow()
            limit = max(LIMIT, (pc.sum(found["n"]).as_py() or 0) // SPLITS)
            found = found.filter(pc.greater(found["n"], limit))
        else:
            found = sizes.filter(F.col("n") > limit).toArrow()
        if not found.num_rows:
            break
        out.append(np.sort(found["context"].to_numpy().astype(np.int64).view(U)))
    return out


_NO_SIZES = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["context", "n"])


def dealt(counts: DataFrame, large: list[np.ndarray], trees: int) -> DataFrame:
    """(tree, keys, counts): the grams, those of subtrees that are split dealt anew by the parts' names."""
    rows = counts.filter(f"kind = {GRAM}").select("tree", "keys", "counts")
    if not large:
        return rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, packed, times in _rows(batches, ["tree", "keys", "counts"]):
            keys = _inflated(packed, U, True)
            top = _tops(keys, large)
            if (top == TOP).all():
                yield _batch([(tree, packed, times)], "tree int, keys binary, counts binary")
                continue
            name = np.choose(top - TOP, [keys & _mask(d) for d in range(TOP, TOP + len(large) + 1)]) | top.astype(U)
            tree_of = np.where(top == TOP, tree, (mix(name) % U(trees)).astype(np.int64))
            yield _batch([(t, _deflated(k, True), _deflated(c, False)) for t, (k, c) in _parts(tree_of, keys, _inflated(times, U, False))], "tree int, keys binary, counts binary")
        release()

    return rows.mapInArrow(work, "tree int, keys binary, counts binary")


_STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680]


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov block probability of a zeros and b ones."""

    def lgamma(x: np.ndarray) -> np.ndarray:  # for x >= 0.5, through x + 8 and Stirling's series (error below 1e-12)
        y = x + 8
        r = 1 / y
        q = r * r
        series = r * (_STIRLING[0] + q * (_STIRLING[1] + q * (_STIRLING[2] + q * _STIRLING[3])))
        shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
        return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift

    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(np.pi)


def _folded(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted, one, stop) of nodes with a zeros and b ones; ``below`` is what their children are worth, None at leaves."""
    kt = _log_kt(a, b)
    weighted = kt if below is None else np.logaddexp(kt, below) - np.log(2)
    stop = np.ones(len(kt)) if below is None else np.exp(kt - weighted - np.log(2))
    return weighted, (b + 0.5) / (a + b + 1), stop


class Subtrees:
    """Whole subtrees below the last ``top`` bytes of context, from their sorted grams and training counts.

    A level has the distinct (context, byte) pairs. A node is a run of them that agree in context and first bits, so all
    nodes of a level and a number of bits are cut from one sorted array. Counts of zero are contexts that nothing
    was learned in: their estimate is one half at every depth.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int = TOP):
        self.depth, self.top, self.keys, self.counts, self.parents = depth, top, {depth: keys}, {depth: n.astype(float)}, {}
        for d in range(depth - 1, top - 1, -1):
            code = (self.keys[d + 1] & _mask(d)) | self.keys[d + 1] & U(255)
            order = np.argsort(code, kind="stable")
            code = code[order]
            fresh = np.concatenate([[True], code[1:] != code[:-1]])
            place = np.empty(len(code), np.int64)
            place[order] = np.cumsum(fresh) - 1
            self.keys[d], self.parents[d + 1] = code[fresh], place
            self.counts[d] = np.bincount(place, self.counts[d + 1], int(fresh.sum()))

    def nodes(self, d: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the nodes of ``bits`` bits begin, and each pair's node."""
        run = self.keys[d] >> U(8 - bits)
        fresh = np.concatenate([[True], run[1:] != run[:-1]])
        return np.flatnonzero(fresh), np.cumsum(fresh) - 1

    def code(self, d: int, bits: int, starts: np.ndarray, context: int) -> np.ndarray:
        """Names of nodes with only the last ``context`` bytes of their context."""
        keys = self.keys[d][starts]
        return (keys & _mask(context)) | U(1 << bits) | (keys & U(255)) >> U(8 - bits)

    def _levels(self, bits: int) -> tuple[dict[int, tuple], tuple[np.ndarray, ...]]:
        """{d: (starts, node of each pair, one, stop)}, and (code, a, b, below) that the topmost nodes give to their parents."""
        out, below = {}, None
        for d in range(self.depth, self.top - 1, -1):
            starts, node = self.nodes(d, bits)
            total = np.add.reduceat(self.counts[d], starts)
            b = np.add.reduceat(self.counts[d] * (self.keys[d] >> U(7 - bits) & U(1)).astype(float), starts)
            if d < self.depth:
                lower = out[d + 1][0]
                below = np.bincount(node[self.parents[d + 1][lower]], weighted, len(starts))
            weighted, one, stop = _folded(total - b, b, below)
            out[d] = starts, node, one, stop
        return out, (self.code(self.top, bits, starts, self.top - 1), total - b, b, weighted)

    def above(self) -> tuple[np.ndarray, ...]:
        """(code, a, b, below), summed, of the nodes one level above the subtrees."""
        every = [self._levels(bits)[1] for bits in range(8)]
        return _summed(*(np.concatenate(z) for z in zip(*every)))

    def scores(self, upper: list[Level]) -> np.ndarray:
        """log10 probability of each gram's byte; ``upper`` has the levels above."""
        out = np.zeros(len(self.keys[self.depth]))
        for bits in range(8):
            levels = self._levels(bits)[0]
            starts = levels[self.top][0]
            p, left = np.zeros(len(starts)), np.ones(len(starts))
            for d, (codes, one, stop) in enumerate(upper[: self.top]):
                at = np.searchsorted(codes, self.code(self.top, bits, starts, d))
                p, left = p + left * stop[at] * one[at], left * (1 - stop[at])
            for d in range(self.top, self.depth + 1):
                starts, node, one, stop = levels[d]
                if d > self.top:
                    up = levels[d - 1][1][self.parents[d][starts]]
                    p, left = p[up], left[up]
                p, left = p + left * stop * one, left * (1 - stop)
            bit = (self.keys[self.depth] >> U(7 - bits) & U(1)) == 1
            out += np.where(bit, np.log10(p)[node], np.log10(1 - p)[node])
        return out


Given = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # code, a, b and below of nodes, from what lies under them


def _upper(given: list[Given]) -> list[Level]:
    """The levels above the subtrees, the root first; ``given`` has for each level what subtrees give to it."""
    out: list[Level] = []
    folded: list[Given] = []  # what nodes above the subtrees give to the next level
    for d in range(len(given) - 1, -1, -1):
        code, a, b, below = _summed(*(np.concatenate(z) for z in zip(given[d], *folded)))
        weighted, one, stop = _folded(a, b, below)
        out.insert(0, (code, one, stop))
        if d:
            folded = [((code & _mask(d - 1)) | code & U(255), a, b, weighted)]
    return out


GROWN = "tree int, top int, keys binary, counts binary, code long, a double, b double, below double"


def grown(grams: DataFrame, large: list[np.ndarray], depth: int) -> DataFrame:
    """Rows of whole subtrees (about ``UNIT`` grams, or one subtree), and what their nodes give to the level above.

    ``top`` is the number of context bytes that name the subtrees of a row, ``large`` the contexts that are split.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        held: list[Counts] = []

        def units(top: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            unit = keys & _mask(top)
            edges = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            cuts = edges[np.concatenate([[True], edges[1:] // UNIT != edges[:-1] // UNIT])].tolist()
            for s, e in zip(cuts, [*cuts[1:], len(keys)]):
                code, a, b, below = Subtrees(keys[s:e], n[s:e], depth, top).above()
                yield _batch([(at, top, _deflated(keys[s:e], True), _deflated(n[s:e], False), None, None, None, None)], GROWN)
                none = [pa.nulls(len(code), t) for t in (pa.int32(), pa.binary(), pa.binary())]
                columns = [none[0], pa.array(np.full(len(code), top, np.int32)), *none[1:], pa.array(code.view(np.int64)), pa.array(a), pa.array(b), pa.array(below)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in GROWN.split(", ")])

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, n = _merged(held)
            for top, columns in _parts(_tops(keys, large), keys, n):
                yield from units(top, *columns)

        for tree, keys, counts in _rows(batches, ["tree", "keys", "counts"]):
            if at != tree:
                yield from done()
                at, held = tree, []
            held.append((_inflated(keys, U, True), _inflated(counts, U, False)))
        yield from done()
        held = []
        release()

    return grams.repartition("tree").sortWithinPartitions("tree").mapInArrow(work, GROWN)


ANSWERS = "chunk long, kind int, bucket int, keys binary, counts binary"


def modelled(trees: DataFrame, upper: list[Level], depth: int, buckets: int) -> DataFrame:
    """(chunk -1, kind, bucket, keys, counts): each bucket's grams with their log probabilities, as answers."""
    shared = trees.sparkSession.sparkContext.broadcast(upper)  # at most 65,280 nodes, and 255 a subtree that is split

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, packed, counts in _rows(batches, ["top", "keys", "counts"]):
            keys = _inflated(packed, U, True)
            logp = Subtrees(keys, _inflated(counts, U, False), depth, top).scores(shared.value)
            answer = np.rint(-logp * FRACTION).astype(U)
            rows = [(-1, GRAM, bucket, _deflated(k, True), _deflated(v, False)) for bucket, (k, v) in _parts(_bucket(keys, buckets), keys, answer)]
            yield _batch(rows, ANSWERS)
        release()

    return trees.filter("keys is not null").select("top", "keys", "counts").mapInArrow(work, ANSWERS)


def answered(asks: DataFrame, model: DataFrame) -> DataFrame:
    """The model's rows (chunk -1) dealt out to the chunks that asked.

    Words wait until they are as many as the bucket's, so that these are hashed no oftener than the asked ones are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        known: list[Counts] = []
        words: list[pa.Array] = []
        times: list[np.ndarray] = []
        waiting: list[tuple[int, bytes, pa.Array]] = []

        def told() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            place = np.asarray(pc.index_in(pa.concat_arrays([w for _, _, w in waiting]), words[0]))
            cuts = np.cumsum([0, *(len(w) for _, _, w in waiting)])
            for (chunk, keys, _), a, b in zip(waiting, cuts, cuts[1:]):
                yield _batch([(chunk, WORD, at[1], keys, _deflated(times[0][place[a:b]], False))], ANSWERS)
            waiting.clear()

        for chunk, kind, bucket, keys, counts in _rows(batches, ["chunk", "kind", "bucket", "keys", "counts"]):
            if at != (kind, bucket):
                yield from told()
                at, known, words, times = (kind, bucket), [], [], []
            if chunk < 0 and kind == GRAM:
                known.append((_inflated(keys, U, True), _inflated(counts, U, False)))
            elif chunk < 0:
                words.append(_split(keys))
                times.append(_inflated(counts, U, False))
            elif kind == GRAM:
                _merged(known)  # the pieces have different grams
                answer = known[0][1][np.searchsorted(known[0][0], _inflated(keys, U, True))]
                yield _batch([(chunk, kind, bucket, keys, _deflated(answer, False))], ANSWERS)
            else:
                if len(words) > 1:
                    words, times = [pa.concat_arrays(words)], [np.concatenate(times)]
                waiting.append((chunk, keys, _split(keys)))
                if sum(len(w) for _, _, w in waiting) >= len(words[0]):
                    yield from told()
        yield from told()
        known, words, times = [], [], []
        release()

    rows = asks.filter("kind is not null").select("chunk", "kind", "bucket", "keys", "counts").unionByName(model)
    return rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk").mapInArrow(work, ANSWERS)


class Table:
    """Open addressing over up to ``size`` distinct 64-bit keys, looked up a block at a time."""

    def __init__(self, size: int):
        self.bits = max(4, (3 * size // 2).bit_length())
        self.slots = np.full(1 << self.bits, ~U(0), U)  # no gram: its top byte is empty
        self.values = np.zeros(1 << self.bits)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in keys that the table doesn't hold."""
        todo, at = np.arange(len(keys)), self._first(keys)
        while len(todo):
            place = at[todo]
            free = self.slots[place] == ~U(0)
            self.slots[place[free]] = keys[todo[free]]
            won = self.slots[place] == keys[todo]
            self.values[place[won]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        x = keys * U(0x9E3779B97F4A7C15)
        return (((x ^ x >> U(29)) * U(0xBF58476D1CE4E5B9)) >> U(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which the table holds."""
        at = self._first(keys)
        miss = np.flatnonzero(self.slots[at] != keys)
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            miss = miss[self.slots[at[miss]] != keys[miss]]
        return self.values[at]


SCORED = "doc_id long, n_tokens long, n_bytes long, n_known long, base_score double, score double"
_SCORED = [*[pa.int64()] * 4, *[pa.float64()] * 2]


def scored(asks: DataFrame, answers: DataFrame, space: int, depth: int) -> DataFrame:
    """A row for each document, from the chunks' texts and answers; ``space`` divides the base's counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        found: list[tuple[bytes, bytes]] = []  # packed until the table is made
        table: Table | None = None
        told: list[pa.Table] = []
        words: pa.Array | None = None
        for chunk, kind, keys, counts, packed, ids, sizes in _rows(batches, ["chunk", "kind", "keys", "counts", "body", "ids", "sizes"]):
            if at != chunk:
                at, found, table, told, words = chunk, [], None, [], None
            if kind == GRAM:
                found.append((keys, counts))
                continue
            if kind == WORD:
                told.append(_word_table(_split(keys), _inflated(counts, U, False)))
                continue
            if table is None:
                table = Table(sum(zstandard.frame_content_size(k) for k, _ in found) // 8)
                for some_keys, some_counts in found:
                    table.add(_inflated(some_keys, U, True), _inflated(some_counts, U, False).astype(float) / -FRACTION)
                found = []
                every, told = pa.concat_tables(told), []
                words, times = every["word"].combine_chunks(), every["n"].to_numpy()
                known, base = times > 0, np.log10((times + 1.0) / space)
                end = pc.index_in(pa.array([END], words.type), words)[0].as_py()
            body, ends = zstandard.decompress(packed), np.cumsum([0, *sizes]).tolist()
            some = [body[s:e] for s, e in zip(ends, ends[1:])]
            score = np.add.reduceat(table.of(grams(some, depth)), np.array(ends[:-1]) + np.arange(len(some)))
            mine, owner = words_of(some)
            at_word = np.concatenate([np.asarray(pc.index_in(mine.cast(words.type), words)).astype(np.int64), np.full(len(some), end)])
            owner = np.concatenate([owner, np.arange(len(some))])
            n_tokens, n_known, bases = (np.bincount(owner, w, len(some)) for w in (None, known[at_word], base[at_word]))
            columns = [ids, n_tokens, [n + 1 for n in sizes], n_known.astype(np.int64), bases, score]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCORED)], [f.split()[0] for f in SCORED.split(", ")])
        table = told = words = every = times = known = base = mine = owner = at_word = None
        release()

    rows = asks.filter("kind is null").select("chunk", F.lit(2).alias("kind"), "part", "keys", "counts", "body", "ids", "sizes")
    none = {c: F.lit(None).cast(t) for c, t in (("part", "long"), ("body", "binary"), ("ids", "array<long>"), ("sizes", "array<long>"))}
    tasks = max(shuffle_partitions(asks.sparkSession), rows.select("chunk").distinct().count())  # a chunk is a task's work
    rows = rows.unionByName(answers.drop("bucket").withColumns(none))
    return rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "part").mapInArrow(work, SCORED)


def score(documents: DataFrame, training: Column, depth: int = DEPTH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    ``training`` is a condition on the documents' columns. ``base_score`` is the log10 probability under the words'
    own frequencies with one added to each, the end sign counting as a word; n_known counts tokens seen in training.
    ``depth`` is from 2 to 6.
    """
    buckets = shuffle_partitions(documents.sparkSession)
    asks = written(asked(documents, training, depth, buckets, chunk), "lm-asked")
    counts = written(counted(asks, 4 * buckets), "lm-counted")
    large = too_large(counts, depth)
    words = counts.filter(f"kind = {WORD}").select(F.lit(-1).cast("long").alias("chunk"), "kind", "bucket", "keys", "counts")
    trees = written(grown(dealt(counts, large, 4 * buckets), large, depth), "lm-grown")
    top = trees.filter("code is not null").groupBy("top", "code").agg(*(F.sum(c).alias(c) for c in ("a", "b", "below"))).toArrow()
    upper = _upper([_given(top, d + 1) for d in range(TOP + len(large))])
    answers = answered(asks, modelled(trees, upper, depth, buckets).unionByName(words))
    total, space = _totals(counts)
    out = scored(asks, answers, space, depth)
    bits = -F.col("score") * float(np.log2(10)) / F.col("n_bytes")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def _given(sums: pa.Table, top: int) -> Given:
    """What the subtrees that ``top`` bytes name give to the level above them."""
    mine = sums.filter(pc.equal(sums["top"], top))
    return mine["code"].to_numpy().astype(np.int64).view(U), *(mine[c].to_numpy() for c in ("a", "b", "below"))


def _totals(counts: DataFrame) -> tuple[int, int]:
    """Training tokens, and the base's divisor: they, the distinct ones and one more."""
    row = counts.filter(f"kind = {WORD}").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    return int(row[0]), int(row[0] + row[1] + 1)
