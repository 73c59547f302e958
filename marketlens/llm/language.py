"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds its sample of labelled text. A text is parsed greedily into the longest
phrases that the automaton contains; the language that needs the fewest phrases, weighted by the bits of a pointer into
its sample, explains the text best. Every letter of the samples has a symbol of its own.

An automaton's transitions lie in one array, each state's at its own offset, so memory goes with the sample and not with
the alphabet. Thousands of segments of texts step through an automaton together, each as if a phrase began with it;
then every segment's parse is continued into the next one until both are in the same state, from where they agree.
So the phrases are exactly those of one greedy parse of the whole text.

The sample is bounded, and is the model's only bound: per language ``SAMPLE`` characters, or an even share of ``TOTAL``
where there are more languages (at most twice that, as the last text is taken whole), from the first ``SAMPLE`` characters
of training rows in the order of a hash. Predictions use whole texts. Only the text decides; labels, source and id play
no part.

A null or letter-free text is ``und`` with score 0, and so is every text where nothing could be learned. Ties go to the
first language in alphabetical order. Null labels teach nothing. Repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import common
from marketlens.llm.common import aside, slices, texts, tidy, written

SAMPLE = 30_000  # characters of labelled text per language
TOTAL = 3_000_000  # characters of all languages together
SEGMENT = 512  # symbols that one lane parses at first
WINDOW = 1 << 21  # symbols of a text that are laid out at a time
UND = "und"
SHIFT = 28  # bits of a state; phrases that end are counted above
MASK = (1 << SHIFT) - 1


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters as one space."""
    return np.frombuffer("".join(c if c.isalpha() else " " for c in text.lower()).encode("utf-32-le"), "<u4")


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Automaton:
    """The transitions of a suffix automaton in one array, for many lanes at once.

    A state's transitions stand at its offset plus their symbols, marked with the state. A missing one ends the phrase;
    its symbol starts the next one, or is one itself where the sample lacks it. Values hold phrases above the state.
    """

    def __init__(self, sequence: np.ndarray, symbols: int):
        moves = automaton(sequence.tolist())
        size = symbols + sum(map(len, moves)) * 2 + 2 * symbols
        self.base = np.full(len(moves), symbols, np.int64)
        self.owner, self.value = np.full(size + 2048, -1, np.int32), np.zeros(size + 2048, np.int64)
        root = np.full(symbols, 1 << SHIFT, np.int64)
        root[list(moves[0])] = list(moves[0].values())
        self.miss = root + (1 << SHIFT)
        self.owner[symbols : 2 * symbols], self.value[symbols : 2 * symbols] = 0, root
        free = np.ones(len(self.owner), bool)
        free[: 2 * symbols] = False
        at = symbols  # offsets from here on are tried
        branching = [s for s in range(1, len(moves)) if len(moves[s]) > 1]
        for s in sorted(branching, key=lambda s: -len(moves[s])):
            own = np.array(list(moves[s]))
            place, tried = at, 0
            while True:
                if place + symbols + 1024 > len(self.owner):
                    self.owner, self.value = (np.concatenate([x, np.full(len(x), z, x.dtype)]) for x, z in ((self.owner, -1), (self.value, 0)))
                    free = np.concatenate([free, np.ones(len(free), bool)])
                fits = np.logical_and.reduce([free[place + c : place + c + 1024] for c in own.tolist()])
                k = int(fits.argmax())
                if fits[k]:
                    break
                place, tried = place + 1024, tried + 1
            if tried > 4:  # the front is crowded
                at = place
            own += place + k
            self.base[s], free[own], self.owner[own], self.value[own] = place + k, False, s, list(moves[s].values())
        single = [s for s in range(1, len(moves)) if len(moves[s]) == 1]
        spots = np.flatnonzero(free)
        if len(single) > len(spots) - symbols:
            more = len(single) + symbols
            self.owner, self.value = np.concatenate([self.owner, np.full(more, -1, np.int32)]), np.concatenate([self.value, np.zeros(more, np.int64)])
            spots = np.concatenate([spots, np.arange(len(free), len(free) + more)])
        spots = spots[: len(single)]
        symbol, target = (np.array([f(moves[s]) for s in single], np.int64) for f in (lambda m: next(iter(m)), lambda m: next(iter(m.values()))))
        self.base[single], self.owner[spots], self.value[spots] = spots - symbol, single, target
        end = int(max(np.flatnonzero(self.owner >= 0)[-1] + 1, self.base.max() + symbols))
        pad = end - len(self.owner)
        self.owner = np.concatenate([self.owner, np.full(max(pad, 0), -1, np.int32)])[:end]
        self.value = np.concatenate([self.value, np.zeros(max(pad, 0), np.int64)])[:end]
        self.bits = float(np.log2(len(sequence) + 2))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = self.base.take(state) + symbol
        return np.where(self.owner.take(at) == state, self.value.take(at), self.miss.take(symbol))

    def phrases(self, steps: np.ndarray, active: np.ndarray, following: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases that end in each lane, and its last state, where the lanes of a text are parsed as one.

        ``steps`` has a column of symbols for each lane, ``active`` how many lanes have a symbol at each step (lanes
        stand in the order of falling length), ``following`` the next lane of the text, or -1, and ``entry`` the state
        that a text's first lane begins with.
        """
        n = len(lengths)
        states, counts = np.zeros((len(steps) + 1, n), np.int32), np.zeros((len(steps) + 1, n), np.int32)
        state, count = entry.copy(), np.zeros(n, np.int32)
        states[0] = state
        for k, (symbol, m) in enumerate(zip(steps, active.tolist())):
            value = self.step(state[:m], symbol[:m])
            count[:m] += value >> SHIFT
            state[:m] = value & MASK
            states[k + 1], counts[k + 1] = state, count
        end = state.copy()
        total = count.astype(np.int64)
        lane = np.flatnonzero(following >= 0)
        lane, state = following[lane], end[lane]  # lanes to be entered, and the state that enters
        while len(lane):  # a round leaves lanes whose last state was wrong, and their followers are entered again
            changed: list[tuple[np.ndarray, np.ndarray]] = []
            count = np.zeros(len(lane), np.int64)
            for k in range(len(steps) + 1):
                done = lengths[lane] == k
                same = states[k, lane] == state
                if same.any() or done.any():
                    total[lane[same]] = count[same] + counts[lengths[lane[same]], lane[same]] - counts[k, lane[same]]
                    late = done & ~same
                    total[lane[late]] = count[late]
                    changed.append((lane[late], state[late]))
                    # what the entered lane passes on is what its own parse passed on, once they agree
                    again = same & (end[lane] != states[lengths[lane], lane])
                    changed.append((lane[again], states[lengths[lane[again]], lane[again]].astype(np.int64)))
                    rest = ~(same | done)
                    lane, state, count = lane[rest], state[rest], count[rest]
                if not len(lane):
                    break
                value = self.step(state, steps[k, lane])
                count += value >> SHIFT
                state = value & MASK
            which, last = (np.concatenate(z) for z in zip(*changed)) if changed else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            new = end[which] != last
            which, last = which[new], last[new]
            end[which] = last
            lane, state = following[which], last
            lane, state = lane[lane >= 0], state[lane >= 0]
        return total, end


def _lanes(sequences: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Non-empty sequences cut into lanes in the order of falling length, and where each sequence's first and last are."""
    sizes = np.array([len(s) for s in sequences])
    lanes = -(-sizes // SEGMENT)
    ends = np.cumsum(lanes)
    owner = np.repeat(np.arange(len(sequences)), lanes)
    within = np.arange(len(owner)) - np.repeat(ends - lanes, lanes)
    lengths = np.minimum(SEGMENT, sizes[owner] - within * SEGMENT)
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    following = np.where(within + 1 < lanes[owner], np.concatenate([place[1:], [-1]]), -1)
    grid = np.zeros((len(owner), SEGMENT), np.int32)
    grid[np.arange(SEGMENT) < lengths[:, None]] = np.concatenate(sequences)
    steps = np.ascontiguousarray(grid[order].T, np.int64)[: lengths.max()]
    active = np.searchsorted(-lengths[order], -np.arange(len(steps)), "left")
    return {"steps": steps, "active": active, "following": following[order], "lengths": lengths[order], "owner": owner[order], "first": place[ends - lanes], "last": place[ends - 1]}


class Model:
    def __init__(self, samples: list[tuple[str, list[str]]]):
        self.languages = [lang for lang, _ in samples]
        joined = [np.concatenate([normal(t + " ") for t in ts]) for _, ts in samples]
        every = np.unique(np.concatenate([*joined, np.zeros(0, "<u4")]))
        self.letters = every[every != 32]
        self.alphabetic = np.frombuffer(bytes(chr(c).isalpha() for c in range(1 << 16)), bool)
        self.automata = [Automaton(self.symbols(codes), len(self.letters) + 2) for codes in joined]
        self.bits = [a.bits for a in self.automata]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points: 0 no letter, 1 a letter that no sample has; runs of non-letters become one 0."""
        low = codes < 1 << 16
        s = np.where(low, self.alphabetic[np.where(low, codes, 0)], False).astype(np.int64)
        for at in np.flatnonzero(~low).tolist():
            s[at] = int(chr(codes[at]).isalpha())
        if len(self.letters):
            at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
            s = np.where((self.letters[at] == codes) & (s > 0), at + 2, s)
        return (s[(s != 0) | (np.concatenate([[1], s[:-1]]) != 0)] if len(s) else s).astype(np.int32)

    def phrases(self, sequences: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases each text needs."""
        out = np.zeros((len(sequences), len(self.automata)))
        states = np.zeros((len(self.automata), len(sequences)), np.int64)
        for at in range(0, max(map(len, sequences)), WINDOW):
            mine = [i for i, s in enumerate(sequences) if len(s) > at]
            layout = _lanes([sequences[i][at : at + WINDOW] for i in mine])
            first, last, owner = layout.pop("first"), layout.pop("last"), layout.pop("owner")
            for k, automaton in enumerate(self.automata):
                entry = np.zeros(len(owner), np.int64)
                entry[first] = states[k, mine]
                count, end = automaton.phrases(**layout, entry=entry)
                out[mine, k] += np.bincount(owner, count, len(mine))
                states[k, mine] = end[last]
        return out + (states.T != 0)  # and the phrase that is open

    def predict(self, batch: list[bytes]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores and mean letters a phrase."""
        sequences = [self.symbols(np.frombuffer(t.decode().lower().encode("utf-32-le"), "<u4")) for t in batch]
        some = [i for i, s in enumerate(sequences) if (s > 0).any()]
        langs, scores, lengths = [UND] * len(batch), [0.0] * len(batch), [0.0] * len(batch)
        if not some or not self.languages:
            return langs, scores, lengths
        phrases = self.phrases([sequences[i] for i in some])
        cost = phrases * np.array(self.bits)
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(some)), best]
        second = np.partition(cost, 1, axis=1)[:, 1] if len(self.languages) > 1 else np.full(len(some), np.inf)
        for row, i in enumerate(some):
            langs[i] = self.languages[best[row]]
            scores[i] = float(1 - least[row] / (least[row] + second[row])) if np.isfinite(second[row]) else 1.0
            lengths[i] = float(len(sequences[i]) / phrases[row, best[row]])
        return langs, scores, lengths


def sample(documents: DataFrame, training: Column, chars: int = SAMPLE, total: int = TOTAL) -> list[tuple[str, list[str]]]:
    """Bounded training text for each language, in alphabetical order of the languages.

    Rows are thinned by their hash to a few times the bound before the window, so no language is gathered whole.
    """
    rows = documents.filter(training & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", F.substring("text", 1, chars).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    totals = written(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")), "language-totals")  # a table whose size Spark knows, so it broadcasts it if small
    chars = max(1, min(chars, total // max(1, totals.count())))
    share = totals.select("lang", F.least(F.lit(1.0), F.lit(8.0 * chars) / F.col("n")).alias("share"))
    thin = rows.join(share, "lang").filter(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * (1 << 30)).withColumn("text", F.substring("text", 1, chars))
    order = Window.partitionBy("lang").orderBy("h", "text")
    thin = thin.withColumn("before", F.sum(F.length("text")).over(order) - F.length("text")).filter(F.col("before") < chars)
    out: dict[str, list[str]] = {}
    for r in sorted(thin.select("lang", "text", "before").collect(), key=lambda r: (r.lang, r.before)):
        out.setdefault(r.lang, []).append(r.text)
    return sorted(out.items())


def predict(documents: DataFrame, samples: list[tuple[str, list[str]]], keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id by default) with lang_pred, score and phrase_length (letters a phrase)."""
    keep = keep or ["doc_id"]
    shared = documents.sparkSession.sparkContext.broadcast(samples)  # bounded: twice TOTAL characters
    key = ("language", id(samples), tuple((lang, sum(map(len, t))) for lang, t in samples), hash(str(samples)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.keep(key, lambda: Model(shared.value))
        for batch in slices(batches, "_text"):
            langs, scores, lengths = model.predict(texts(batch, "_text"))
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], [*keep, "lang_pred", "score", "phrase_length"])

    rows = documents.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)
    return rows.mapInArrow(tidy(work), f"{kinds}, lang_pred string, score double, phrase_length double")


def accepted(documents: DataFrame, least_length: float = 1.5) -> DataFrame:
    """A filter: the documents whose text is in a learned language, with their own columns.

    Rejected are texts without letters and texts that even the best language explains no better than letter by letter.
    """
    learned = sample(documents, F.lit(True))
    good = (F.col("lang_pred") != UND) & (F.col("phrase_length") >= least_length)
    return aside(documents, lambda docs: predict(docs, learned, docs.columns).filter(good))
