"""Fill-in-middle: documents cut in three and put in another order, with cuts looked up in a learned rank index.

A text's tokens are runs of white space (may be none) with the word behind them, and white space at the end. The offsets
of all token ends of a run of texts ascend, so they make an index from rank to offset: straight lines are fitted to
them, each as long as no offset lies more than ``ERROR`` bytes off, and the distance of each offset from its line is kept as one
byte. A cut after k tokens is predicted by its line and put right by its residual, which gives the exact offset. A line
covers more than ``ERROR`` bytes unless texts end, so the lines of 2 MB of text are some 20,000 at worst.

Cuts depend on the document's id and a seed alone: not on partitions, order or other documents. The markers stand
in no text that is cut, and a piece can't complete one, so the output can be turned back.

A null text counts as empty; a null id draws as an empty one would. Rows that repeat an id draw alike, each for its own text.
Texts of any length are cut whole. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import byte_class, flat, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 100  # bytes; residuals fit one byte
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


class RankIndex:
    """Ascending offsets by rank: lines through (rank, offset) and residuals of one byte."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR) -> None:
        if not 0 <= error <= 126:
            raise ValueError("residuals take one byte")
        firsts, slopes, at, n = [], [], 0, len(offsets)
        while at < n:
            low, high, end, width = -np.inf, np.inf, at + 1, 512
            while end < n:  # the cone of slopes that pass within the error of all offsets so far
                stop = min(n, end + width)
                run, rise = np.arange(end - at, stop - at), offsets[end:stop] - offsets[at]
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                shut = lows > highs
                k = int(shut.argmax()) if shut.any() else stop - end
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                end += k
                if end < stop:
                    break
                width *= 2
            firsts.append(at)
            slopes.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        self.firsts, self.slopes = np.array(firsts, np.int64), np.array(slopes)
        self.origins = offsets[self.firsts] if n else np.zeros(0, np.int64)
        self.residuals = np.zeros(n, np.int8)
        if n:
            self.residuals = (offsets - self.predict(np.arange(n))).astype(np.int8)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        line = np.searchsorted(self.firsts, ranks, "right") - 1
        return self.origins[line] + np.rint(self.slopes[line] * (ranks - self.firsts[line])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets at these ranks."""
        return self.predict(ranks) + self.residuals[ranks]


def token_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the tokens of texts laid end to end, which ``bounds`` delimit."""
    space = SPACE[data]
    end = ~space & np.append(space[1:], True)
    end[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    return np.flatnonzero(end) + 1


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def transform(documents: DataFrame, seed: int = 42, share: int = 50, suffix_first: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text: n its tokens, form plain, psm or spm.

    ``share`` percent of the documents are cut, ``suffix_first`` percent of those into spm; texts that are empty or hold
    a marker stay plain.
    """
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = flat(batch)
            index = RankIndex(ends := token_ends(data, bounds))
            first = np.searchsorted(ends, bounds[:-1], "right")  # rank of a text's first token
            n = np.searchsorted(ends, bounds[1:], "right") - first
            whole, ids = data.tobytes(), batch.column("doc_id").to_pylist()
            draws = np.array([_draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            cut = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            at = np.repeat(bounds[:-1, None], 2, axis=1)
            at[cut > 0] = index.offsets((first[:, None] + cut - 1)[cut > 0])
            forms, prefixes, middles, outputs = [], [], [], []
            for i in range(len(ids)):
                text = whole[bounds[i] : bounds[i + 1]]
                if not text or draws[i, 2] % 100 >= share or p in text or s in text or m in text:
                    form, pre, mid, out = "plain", None, None, text
                else:
                    a, b = at[i]
                    head, middle, tail = whole[bounds[i] : a], whole[a:b], whole[b : bounds[i + 1]]
                    pre, mid = _chars(data[bounds[i] : a]), _chars(data[a:b])
                    form = "spm" if draws[i, 3] % 100 < suffix_first else "psm"
                    out = s + tail + p + head + m + middle if form == "spm" else p + head + s + tail + m + middle
                for column, value in zip((forms, prefixes, middles, outputs), (form, pre, mid, out)):
                    column.append(value)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, third = (F.get(parts, i) for i in (1, 2, 3))
    psm, spm = F.concat(first, third, second), F.concat(second, third, first)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
