"""Source divergence audit: how far the word use of a source lies from that of the others of its language.

Counting is a sort of pointers. A shard of texts lies in one buffer; pointers to the word starts are put in order by
multikey quicksort with characters of eight bytes: pointers are sorted by the bytes at one depth, and each run of equal
ones goes on, by itself, to the next depth as long as its words do. What remains is runs of equal words, in the order of the texts: a
run's length is the count of a term, its changes of text the document frequency. Shards send their runs, not their
words, to a sum by (language, source, term).

Probabilities are smoothed and in whole billionths, so all arithmetic is exact. Differences are summed over blocks of
terms: a task holds the probabilities of all sources of a language for about ``BLOCK`` terms, and compares ``SIDE`` of
the sources with all; so memory grows with a language's sources alone, and terms and sources are dealt to as many
tasks as there are. Pairs of sources are the result itself; no pairs are made by term.

Null text, language and source count as ''. Rows that repeat an id are documents of their own. A source without any term
has a probability for each kept term all the same; a language without kept terms has differences of 0. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import byte_class, flat, keys_at, lower, release, slices, word_spans, written

LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SHARD = 4 << 20  # bytes of text whose pointers are sorted together
DEEP = 6  # characters of eight bytes, after which words that are still equal are compared whole
BLOCK, SIDE = 1024, 256
UNIT, SMOOTH = 1_000_000_000, 5


def equal_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): pointers by group and word, those of equal words in the order given, and where each run begins.

    ``data`` ends in eight bytes of padding and no word holds a zero byte.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    key = keys_at(data, starts, sizes)
    order = np.argsort(key, kind="stable")
    small = group.astype(np.uint16) if group.max() < 1 << 16 else group
    order = order[np.argsort(small[order], kind="stable")]
    key, by = key[order], group[order]
    head = np.append(True, (key[1:] != key[:-1]) | (by[1:] != by[:-1]))
    for depth in range(1, DEEP + 1):
        run = np.cumsum(head) - 1
        bounds = np.append(np.flatnonzero(head), n)
        longest = np.maximum.reduceat(sizes[order], bounds[:-1])
        open_runs = (np.diff(bounds) > 1) & (longest > 8 * depth)
        at = np.flatnonzero(open_runs[run])  # places in the order, run by run
        if not len(at):
            break
        rows = order[at]
        if depth < DEEP:
            key = keys_at(data, starts[rows] + 8 * depth, sizes[rows] - 8 * depth)
        else:
            tails = [data[a:b].tobytes() for a, b in zip(starts[rows] + 8 * depth, ends[rows])]
            rank = {t: i for i, t in enumerate(sorted(set(tails)))}
            key = np.array([rank[t] for t in tails])
        turn = np.lexsort((key, run[at]))
        order[at], key = rows[turn], key[turn]
        head[at[1:]] |= key[1:] != key[:-1]
    return order, np.flatnonzero(head)


RUNS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _pieces(size: int, data: np.ndarray) -> list[int]:
    """Where a text of more than a shard is cut: next to bytes outside words."""
    outside = np.flatnonzero(~LETTER[data])
    marks = np.searchsorted(outside, np.arange(SHARD, size, SHARD))
    return [0, *np.unique(outside[marks[marks < len(outside)]]).tolist(), size]


def _shard(batch: pa.RecordBatch) -> pa.Table:
    """The runs of one shard; for each (language, source) in it also a row without a term, which counts its texts."""
    pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
    names = sorted(set(pairs))
    code = {p: i for i, p in enumerate(names)}
    home = np.array([code[p] for p in pairs], np.int64)
    raw, offsets = flat(batch)
    parts = []
    cuts = _pieces(len(raw), raw) if len(pairs) == 1 and len(raw) > SHARD else [0, len(raw)]
    for a, b in zip(cuts, cuts[1:]):
        data = lower(raw[a:b])
        starts, ends = word_spans(LETTER[data], np.array([0, b - a]) if len(cuts) > 2 else offsets)
        text = np.searchsorted(offsets, starts + a, "right") - 1
        padded = np.append(data, np.zeros(8, np.uint8))
        order, heads = equal_runs(padded, starts, ends, home[text])
        if len(heads):
            change = np.append(True, np.diff(text[order]) != 0)
            change[heads] = True
            first = order[heads]
            n, df = np.diff(np.append(heads, len(order))), np.add.reduceat(change.astype(np.int64), heads)
            whole = data.tobytes()
            terms = pa.array([whole[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string())
            parts.append((home[text[first]], terms, n, df))
    if len(parts) > 1:  # one text in pieces: a term's counts are added, and it has one document
        merged = pa.table({"term": pa.chunked_array([p[1] for p in parts]), "n": np.concatenate([p[2] for p in parts])}).group_by("term").aggregate([("n", "sum")])
        k = merged.num_rows
        parts = [(np.zeros(k, np.int64), merged["term"].combine_chunks(), merged["n_sum"].to_numpy(), np.ones(k, np.int64))]
    docs = np.bincount(home, minlength=len(names))
    parts.append((np.arange(len(names)), pa.nulls(len(names), pa.string()), docs, docs))
    langs, sources = (pa.array([p[i] for p in names], pa.string()) for i in (0, 1))
    tables = [pa.table([langs.take(pa.array(g)), sources.take(pa.array(g)), t, pa.array(n, pa.int64()), pa.array(d, pa.int64())], schema=RUNS) for g, t, n, d in parts]
    return pa.concat_tables(tables)


def counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term and the documents that hold it; without a term, all documents."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD):
            yield from _shard(batch).to_batches()
        release()

    texts = documents.select("text", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    found = texts.mapInArrow(work, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """Smoothed, in billionths plus one, rounded down: exact, as decimals hold every product."""
    over = (n.cast("decimal(20,0)") + F.lit(SMOOTH)) * F.lit(UNIT)
    under = F.greatest(total.cast("decimal(20,0)") + F.lit(SMOOTH) * terms.cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)"))
    return F.lit(1) + F.call_function("div", over, under)


def _differences(rows: pa.Table) -> pa.Table:
    """Of one block of terms: for each source of the side, its summed difference from each other source."""
    lang, side = rows["lang"][0].as_py(), rows["side"][0].as_py()
    plain = rows.filter(pc.is_null(rows["term"]))  # a row a source, with the probability of a term that it lacks
    names = plain["source"].to_pylist()
    found = rows.filter(pc.is_valid(rows["term"]))
    terms = found["term"].combine_chunks().dictionary_encode()
    p = np.repeat(plain["p"].to_numpy()[:, None], len(terms.dictionary), axis=1)
    at = pc.index_in(found["source"], value_set=plain["source"].combine_chunks()).to_numpy()
    p[at, terms.indices.to_numpy()] = found["p"].to_numpy()
    sides = plain["own"].to_numpy()
    left, right, value = [], [], []
    for i in np.flatnonzero(sides == side):
        sums = np.abs(p - p[i]).sum(axis=1)
        sums_of = [j for j in range(len(names)) if j != i]
        left += [names[i]] * len(sums_of)
        right += [names[j] for j in sums_of]
        value += sums[sums_of].tolist()
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "source": pa.array(left, pa.string()), "item": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})


def audit(documents: DataFrame, least_documents: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance from the others of its language, and its own terms.

    Part ``pair`` holds all other sources, part ``term`` the ``top`` terms that the source uses more than its language.
    """
    found = written(counts(documents), "audit-counts")
    groups = found.filter("term is null").select("lang", "source")
    words = found.filter("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).filter(F.col("df") >= least_documents).drop("df")
    kept = written(kept, "audit-terms")
    used = written(words.drop("df").join(kept, ["lang", "term"]), "audit-used")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    peers = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    zero = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(peers, "lang")
    groups = written(groups.fillna(0, ["total", "terms", "lang_total"]).withColumn("absent", probability(zero, F.col("total"), F.col("terms"))), "audit-groups")

    used = used.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
    gain = used.withColumn("value", F.col("p") - probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    own = gain.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1)).cast("int")
    sides = F.ceil(F.col("sources") / SIDE).cast("int")
    side = F.explode(F.sequence(F.lit(0), sides - 1)).alias("side")
    cells = used.select("lang", "source", "term", "p", F.lit(0).alias("own"), F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), side)
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    every = every.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), F.pmod(F.xxhash64("source"), sides).cast("int").alias("own"), "block", side)
    parts = cells.unionByName(every).groupBy("lang", "block", "side").applyInArrow(_differences, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    nearest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(nearest))
    columns = lambda df, part, item: df.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair", "item").unionByName(columns(own, "term", "term"))
