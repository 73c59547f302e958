"""Quality classification by a generalised additive model with pairwise interactions.

Each text gives a row of plain features. Cyclic boosting goes round the features; a shallow tree on one feature's bins
at a time adds a little to that feature's lookup table. The pairs of features that explain most of what is left then
get two-way tables in the same manner. A score is the sum of the tables' entries at a text's bins, through the logistic
function. The fit takes at most ``FIT_ROWS`` labelled rows, in the order of a hash of their id; features, labels apart,
come from the whole text alone.

A null text counts as empty and is scored like any other. Without labelled rows every score is 0.5. Null labels teach
nothing; an id labelled several ways teaches its smallest label. Repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import aside, slices, texts, tidy

FIT_ROWS = 20_000
BINS, PAIR_BINS = 64, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 10
RATE, LEAST_WEIGHT = 0.15, 5.0

FEATURES = ["bytes", "words", "word_length", "distinct_words", "repeats", "longest_repeat", "lines", "distinct_lines", "upper", "digits", "bars", "bangs", "symbols", "stops", "commas", "wide", "upper_count", "bar_count", "bang_count", "symbol_count"]
# byte classes: 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 newline, 6 bar, 7 bang, 8 symbol, 9 full stop, 10 comma, 11 above ASCII
_CLASS = np.zeros(256, np.int64)
for _cls, _chars in enumerate([bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\r", b"\n", b"|", b"!", b"#$%&*@^~<>{}[]\\=", b".", b",", bytes(range(128, 256))], 1):
    _CLASS[list(_chars)] = _cls


def features(batch: list[bytes]) -> np.ndarray:
    """(texts, features)."""
    n = len(batch)
    owner = np.repeat(np.arange(n), [len(t) for t in batch])
    counts = np.bincount(owner * 12 + _CLASS[np.frombuffer(b"".join(batch), np.uint8)], minlength=n * 12).reshape(n, 12)
    size = np.maximum(counts.sum(axis=1), 1)
    rows = []
    for t in batch:
        words, lines = t.split(), [x for x in t.split(b"\n") if x]
        same, run, longest = 0, 0, 0
        if len(words) > 1:
            equal = list(map(eq, words, words[1:]))
            same = sum(equal)
            if same:
                for e in equal:
                    run = run + 1 if e else 0
                    longest = max(longest, run)
        k, m = max(len(words), 1), max(len(lines), 1)
        rows.append((len(t), len(words), sum(map(len, words)) / k, len(set(words)) / k, same / k, longest, len(lines), len(set(lines)) / m))
    of = lambda c: counts[:, c] / size
    rest = [of(1), of(3), of(6), of(7), of(8), of(9), of(10), of(11), counts[:, 1], counts[:, 6], counts[:, 7], counts[:, 8]]
    return np.column_stack([np.array(rows, float).reshape(n, 8), *rest]) if n else np.zeros((0, len(FEATURES)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal weight; repeated values share a bin."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.zeros(0)


def _bin(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, "right")


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram of gradients and weights; (0, 0) where none has enough weight."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = 0
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over the bins of one feature."""
    gain, at = _cut(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a two-level tree over a two-way histogram: a cut of the rows, then a cut of the columns on each side."""
    best, values = 0.0, np.full(g.shape, g.sum() / (h.sum() + 1))
    for at in range(1, g.shape[0]):
        gain, parts = -(g.sum() ** 2) / (h.sum() + 1), []
        for side in (slice(0, at), slice(at, None)):
            gs, hs = g[side].sum(axis=0), h[side].sum(axis=0)
            more, cut = _cut(gs, hs)
            gain += gs.sum() ** 2 / (hs.sum() + 1) + more
            parts.append((gs, hs, cut))
        if gain > best and min(p[1].sum() for p in parts) >= LEAST_WEIGHT:
            best, rows = gain, []
            for (gs, hs, cut), k in zip(parts, (at, g.shape[0] - at)):
                leaf = np.concatenate([np.full(len(s[0]), s[0].sum() / (s[1].sum() + 1)) for s in ((gs[:cut], hs[:cut]), (gs[cut:], hs[cut:])) if len(s[0])])
                rows.append(np.tile(leaf, (k, 1)))
            values = np.concatenate(rows)
    return best, values


class Gam:
    """Edges and lookup tables; plain arrays, so that it travels with the tasks."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        k = len(FEATURES)
        self.edges = [_edges(x[:, i], BINS) for i in range(k)]
        self.coarse = [_edges(x[:, i], PAIR_BINS) for i in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(rate / (1 - rate)))
        if len(set(y.tolist())) < 2:
            return
        bins = [_bin(x[:, i], e) for i, e in enumerate(self.edges)]
        margin = np.full(len(y), self.base)

        def pulls() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-margin))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for i in range(k):
                g, h = pulls()
                step = RATE * _tree(np.bincount(bins[i], g, len(self.tables[i])), np.bincount(bins[i], h, len(self.tables[i])), 2)
                self.tables[i] += step
                margin += step[bins[i]]
        small = [_bin(x[:, i], e) for i, e in enumerate(self.coarse)]
        sizes = [len(e) + 1 for e in self.coarse]

        def both(i: int, j: int, w: np.ndarray) -> np.ndarray:
            return np.bincount(small[i] * sizes[j] + small[j], w, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

        g, h = pulls()
        gains = sorted(((-_tree2(both(i, j, g), both(i, j, h))[0], i, j) for i in range(k) for j in range(i)))
        self.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain < 0]
        self.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for t, (i, j) in zip(self.pair_tables, self.pairs):
                g, h = pulls()
                step = RATE * _tree2(both(i, j, g), both(i, j, h))[1]
                t += step
                margin += step[small[i], small[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for i, (e, t) in enumerate(zip(self.edges, self.tables)):
            margin += t[_bin(x[:, i], e)]
        small = {i: _bin(x[:, i], self.coarse[i]) for p in self.pairs for i in p}
        for t, (i, j) in zip(self.pair_tables, self.pairs):
            margin += t[small[i], small[j]]
        return 1 / (1 + np.exp(-margin))


def fit(documents: DataFrame, labels: DataFrame, training: Column | None = None, label: str = "quality", rows: int = FIT_ROWS) -> Gam:
    """Fit on at most ``rows`` labelled documents; ``training`` is a condition on the labels' doc_id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if training is None else training))
    known = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(texts(batch))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), lists], ["y", "x"])

    found = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("y", "text")  # at most ``rows`` pairs of numbers
    got = found.mapInArrow(tidy(work), "y int, x array<double>").toArrow()
    x, y = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), len(FEATURES)), got["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same fit however rows come
    return Gam(x[order], y[order])


def score(documents: DataFrame, model: Gam, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id by default) with score, higher where label 1 is likelier."""
    keep = keep or ["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            s = model.score(features(texts(batch, "_text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s)], [*keep, "score"])

    rows = documents.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)
    return rows.mapInArrow(tidy(work), f"{kinds}, score double")


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """A filter: the documents that score at least ``threshold``, with their own columns."""
    model = fit(documents, labels)
    return aside(documents, lambda docs: score(docs, model, docs.columns).filter(F.col("score") >= threshold))
