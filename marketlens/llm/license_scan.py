"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a notice, taken as a set of words. Blocks are windows of 2c words, at every c-th word of the text, where c
is the least power of two that reaches the template's length (8 at least); so every stretch of c words lies whole in a block.
A block matches a template if it holds ``threshold`` of the template's words, and all words that tell the license from others.

The join orders words by how often they occur in all documents, the rarest first, and finds every match by three
filters that drop none. To share k words, the sets must share one of their first (size - k + 1) words (prefix); both must
have k words (length); and at the first shared word what is left of both must still make k (position). Words of
no template can't be shared, so blocks are taken without them. Candidates are then confirmed on full sets. The
templates' words, at most ``UNIVERSE``, are sent to all tasks with their counts; texts aren't shuffled.

Of matches that overlap, one whose telling words are part of another's goes: "cc by nc" is not also "cc by". Beside
the join, ``phrases`` are looked for word by word, and their labels always count.

A null text counts as empty and has no words, labels or places. Rows that repeat an id, or have none, are scanned each for
itself. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import byte_class, flat, keys_at, lower, slices, word_spans

WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
UNIVERSE = 100_000
LEAST = 8  # words of the smallest block's half

# The phrases of the base labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# License notices in common use, as label, telling words, notice.
TEMPLATES = [
    ("mit", "mit", "released under the mit license"),
    ("mit", "permission granted charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "apache 2", "licensed under the apache license version 2 0"),
    ("apache-2", "law writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl-3", "gnu general public 3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu general public 2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "gnu general public 3 redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu general public 2 redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-3", "gnu general public 3 lesser", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-2.1", "gnu general public 2 1 lesser", "licensed under the gnu lesser general public license version 2 1"),
    ("agpl-3", "gnu general public 3 affero", "licensed under the gnu affero general public license version 3"),
    ("bsd-2", "bsd 2", "licensed under the bsd 2 clause license"),
    ("bsd-3", "bsd 3", "licensed under the bsd 3 clause license"),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla public 2", "licensed under the mozilla public license version 2 0"),
    ("isc", "permission granted fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc", "released under the isc license"),
    ("epl-2", "eclipse public 2", "licensed under the eclipse public license version 2 0"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by nc nd", "licensed under cc by nc nd 4 0"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc0", "cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
]


@dataclass
class Words:
    """The words that templates and phrases use, each with its place in the list as id."""

    words: list[bytes]

    def __post_init__(self) -> None:
        if len(self.words) > UNIVERSE:
            raise ValueError(f"more than {UNIVERSE} words in the templates")
        self.ids = {w: i for i, w in enumerate(self.words)}
        joined = np.frombuffer(b"".join(self.words) + b"\0" * 8, np.uint8)
        sizes = np.array([len(w) for w in self.words], np.int64)
        keys = keys_at(joined, np.cumsum(sizes) - sizes, sizes)
        brief = np.flatnonzero(sizes <= 8)
        order = brief[np.argsort(keys[brief])]
        self.brief, self.brief_ids = keys[order], order
        self.openings = np.unique(keys[sizes > 8])

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ids of the words at these spans of lower-case bytes (with eight of padding), -1 for words that no template has."""
        sizes = ends - starts
        keys, out = keys_at(data, starts, sizes), np.full(len(starts), -1, np.int64)
        if len(self.brief):
            at = np.minimum(np.searchsorted(self.brief, keys), len(self.brief) - 1)
            out = np.where((self.brief[at] == keys) & (sizes <= 8), self.brief_ids[at], out)
        if len(self.openings):
            at = np.minimum(np.searchsorted(self.openings, keys), len(self.openings) - 1)
            for i in np.flatnonzero((self.openings[at] == keys) & (sizes > 8)):
                out[i] = self.ids.get(data[starts[i] : ends[i]].tobytes(), -1)
        return out


def _universe(templates: list[tuple[str, str, str]], phrases: list[tuple[str, str]]) -> Words:
    texts = [t for _, _, t in templates] + [k for _, k, _ in templates] + [p for p, _ in phrases]
    return Words(sorted({w.encode() for t in texts for w in t.split()}))


def _read(batch: pa.RecordBatch, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the words of all texts of a batch, and where each text's begin and end."""
    data, offsets = flat(batch)
    data = lower(data)
    starts, ends = word_spans(WORD[data], offsets)
    ids = words.find(np.append(data, np.zeros(8, np.uint8)), starts, ends)
    return ids, np.searchsorted(starts, offsets)


def frequencies(documents: DataFrame, words: Words) -> np.ndarray:
    """How often each word of the templates occurs in all documents; a row a word comes to the driver."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words.words), np.int64)
        for batch in slices(batches, "text"):
            ids, _ = _read(batch, words)
            total += np.bincount(ids[ids >= 0], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["id", "n"])

    out = np.zeros(len(words.words), np.int64)
    for row in documents.select("text").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


@dataclass
class Template:
    label: str
    ranks: list[int]  # places of its words in the global order, ascending
    telling: frozenset[int]
    least: int  # words that a block has to share


class Index:
    """Templates of one block size, by the words of their prefixes."""

    def __init__(self, half: int, templates: list[Template]) -> None:
        self.half, self.least = half, min(t.least for t in templates)
        self.postings: dict[int, list[tuple[Template, int]]] = defaultdict(list)
        for t in templates:
            for i, rank in enumerate(t.ranks[: len(t.ranks) - t.least + 1]):
                self.postings[rank].append((t, i))

    def matches(self, block: list[int]) -> list[tuple[Template, int]]:
        """(template, shared words) of every template that the block, its ranks ascending, holds enough of."""
        seen, out, whole = set(), [], frozenset(block)
        for j, rank in enumerate(block[: len(block) - self.least + 1]):
            for t, i in self.postings.get(rank, ()):
                if id(t) in seen or len(block) < t.least:
                    continue
                seen.add(id(t))  # this is the first shared word, so what is left decides
                if min(len(t.ranks) - i, len(block) - j) >= t.least and t.telling <= whole:
                    shared = len(whole.intersection(t.ranks))
                    if shared >= t.least:
                        out.append((t, shared))
        return out


def indexes(templates: list[tuple[str, str, str]], words: Words, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, list[Index]]:
    """(rank of each word in the global order, an index for each block size)."""
    order = sorted(range(len(words.words)), key=lambda i: (counts[i], words.words[i]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sized = defaultdict(list)
    for label, telling, text in templates:
        parts = text.encode().split()
        ranks = sorted({int(rank[words.ids[w]]) for w in parts})
        tell = frozenset(int(rank[words.ids[w.encode()]]) for w in telling.split())
        half = max(LEAST, 1 << (len(parts) - 1).bit_length())
        sized[half].append(Template(label, ranks, tell, max(1, math.ceil(round(threshold * len(ranks), 9)))))
    return rank, [Index(h, t) for h, t in sorted(sized.items())]


def _told(found: list[tuple[int, int, Template, int]]) -> list[tuple[int, int, Template, int]]:
    """Matches (start, end, template, shared) but those that another, which overlaps, tells more closely."""
    return [m for m in found if not any(m[2].telling < o[2].telling and m[0] < o[1] and o[0] < m[1] for o in found)]


def _blocks(ranks: np.ndarray, bounds: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of the blocks that pass the length filter and hold a word of a prefix; starts within the texts laid end to end."""
    n = np.diff(bounds)
    per = -(-n // index.half)
    text = np.repeat(np.arange(len(n)), per)
    start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * index.half
    end = np.minimum(start + 2 * index.half, bounds[text + 1])
    known = np.append(0, np.cumsum(ranks >= 0))
    first = np.append(0, np.cumsum(np.isin(ranks, list(index.postings))))
    keep = (known[end] - known[start] >= index.least) & (first[end] > first[start])
    yield from zip(text[keep].tolist(), start[keep].tolist(), end[keep].tolist())


MATCH = "array<struct<start: long, end: long, label: string, shared: int, containment: double>>"


def scan(documents: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """(doc_id, n_words, places, matches): where phrases stand, and every block that matches a template; in words from 0."""
    words = _universe(templates, phrases)
    counts = frequencies(documents, words)
    rank, sized = indexes(templates, words, counts, threshold)
    spelled = [(rank[[words.ids[w] for w in p.encode().split()]], label) for p, label in phrases]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, bounds = _read(batch, words)
            ranks = np.where(ids >= 0, rank[ids], -1)
            n = np.diff(bounds)
            places: list[list[dict]] = [[] for _ in n]
            for phrase, label in spelled:
                at = np.arange(max(len(ranks) - len(phrase) + 1, 0))
                for k, r in enumerate(phrase):
                    at = at[ranks[at + k] == r]
                text = np.searchsorted(bounds, at, "right") - 1
                inside = at + len(phrase) <= bounds[text + 1]
                for i, a in zip(text[inside].tolist(), at[inside].tolist()):
                    places[i].append({"start": a - int(bounds[i]), "label": label})
            found: dict[int, list] = defaultdict(list)
            for index in sized:
                for i, a, b in _blocks(ranks, bounds, index):
                    block = np.unique(ranks[a:b])
                    block = block[block >= 0].tolist()
                    if len(block) >= index.least:
                        found[i] += [(a - int(bounds[i]), b - int(bounds[i]), t, s) for t, s in index.matches(block)]
            matches = [[{"start": a, "end": b, "label": t.label, "shared": s, "containment": s / len(t.ranks)} for a, b, t, s in _told(found[i])] if i in found else [] for i in range(len(n))]
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, _PLACES), pa.array(matches, _MATCHES)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places", "matches"])

    schema = f"doc_id long, n_words long, places array<struct<start: long, label: string>>, matches {MATCH}"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("shared", pa.int32()), ("containment", pa.float64())]))


def labels(*lists: str) -> Column:
    """The distinct labels of these columns, in order, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(f"{c}.label") for c in lists)))), ",")


def score() -> Column:
    """The greatest share of a template that a block holds; 1 where a phrase stands."""
    best = F.coalesce(F.array_max("matches.containment"), F.lit(0.0))
    return F.when(F.size("places") > 0, 1.0).otherwise(best)
