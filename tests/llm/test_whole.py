"""That operators do the whole job: contexts at full depth, long texts, near copies."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from marketlens.llm import common, fingerprint, lm_score, packing, quality, queries, token_store
from marketlens.llm.queries import _vocabulary


def _streams(trained, depth, query):
    """A plain context tree over whole texts, by recursion: the log10 probability of the query."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(text):
        s = b"\xff" * depth + text.lower() + b"\xff"
        for i in range(depth, len(s)):
            node = 1
            for k in range(8):
                bit = s[i] >> (7 - k) & 1
                yield s[i - depth : i], node, bit
                node = node * 2 + bit

    for t in trained:
        for ctx, node, bit in bits(t):
            for d in range(depth + 1):
                counts[ctx[depth - d :], node][bit] += 1
    for ctx, node in counts:
        if ctx:
            children[ctx[1:], node].add(ctx)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        own = kt(*counts[ctx, node])
        if len(ctx) == depth:
            return own
        below = sum(weighted(c, node) for c in children[ctx, node])
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    def chance(ctx, node, d=0):
        here = ctx[depth - d :]
        if (here, node) not in counts:
            return 0.5
        a, b = counts[here, node]
        one = (b + 0.5) / (a + b + 1)
        if d == depth:
            return one
        stop = math.exp(kt(a, b) - weighted(here, node) - math.log(2))
        return stop * one + (1 - stop) * chance(ctx, node, d + 1)

    return sum(math.log10(p if bit else 1 - p) for ctx, node, bit in bits(query) for p in [chance(ctx, node)])


def test_whole_texts_are_scored_in_context(spark):
    texts = ["the cat sat on the mat", "mat the on sat cat the", "", "Cat cat\ncat dog é", None, "unseen zebra the", "abcdefgx abcdefgx zbcdefgy zbcdefgy", "qbcdefg"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trained = [(t or "").encode() for i, t in enumerate(texts) if i not in (1, 5)]
    words = Counter(w for t in trained for w in [*t.lower().split(), b"end"])
    n, v = sum(words.values()), len(words)
    for depth, chunk in ((2, 1), (3, 40), (6, 1 << 20)):
        got = {r.doc_id: r for r in lm_score.score(df, ~F.col("doc_id").isin(1, 5), depth, chunk).collect()}
        for i, t in enumerate(texts):
            text = (t or "").encode()
            assert got[i].score == pytest.approx(_streams(trained, depth, text), rel=1e-9)
            assert got[i].bits_per_byte == pytest.approx(-got[i].score * math.log2(10) / (len(text) + 1))
            mine = [*text.lower().split(), b"end"]
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(mine), sum(words[w] > 0 for w in mine), n)
            assert got[i].base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in mine))
        assert got[0].score > got[1].score + 1  # a shuffle of the words is less likely


def test_held_out_texts_gain_by_context(spark):
    got = [r for r in queries.op5_lm_score(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_subtrees_in_several_units(spark, monkeypatch):
    rows = [(i, f"text {i % 7} of {i} words, {i * i} more") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.score for r in lm_score.score(df, F.col("doc_id") % 3 > 0).collect()}
    monkeypatch.setattr(lm_score, "UNIT", 1)
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    assert {r.doc_id: r.score for r in lm_score.score(df, F.col("doc_id") % 3 > 0, chunk=200).collect()} == pytest.approx(whole, rel=1e-9)


@pytest.mark.parametrize("limit, piece", [(1, 1), (4, 3), (40, 1000)])
def test_large_subtrees_are_split(spark, monkeypatch, limit, piece):
    rows = [(i, f"text {i % 7} of {i} words, {i * i} more, หนังสือ {i % 5} ที่อ่าน") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: tuple(r)[1:] for r in lm_score.score(df, F.col("doc_id") % 3 > 0).collect()}
    split = []
    find = lm_score.too_large
    monkeypatch.setattr(lm_score, "LIMIT", limit)
    monkeypatch.setattr(lm_score, "PIECE", piece)
    monkeypatch.setattr(lm_score, "too_large", lambda *a: split.append(find(*a)) or split[-1])
    got = {r.doc_id: tuple(r)[1:] for r in lm_score.score(df, F.col("doc_id") % 3 > 0, chunk=500).collect()}
    assert len(split[0]) == 3 and all(len(c) for c in split[0])  # by the third, fourth and fifth byte
    assert got.keys() == whole.keys() and all(got[i] == pytest.approx(whole[i], rel=1e-9) for i in whole)


def test_scores_take_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (2, ""), (3, "é\t\n  x"), (3, "é\t\n  x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for training in (F.lit(True), F.lit(False), F.col("doc_id") == 3):
        assert lm_score.score(df, training).filter("score is not null and score < 0").count() == 6
    assert lm_score.score(df.limit(0), F.lit(True)).count() == 0


def test_likeness_of_long_repeated_lines():
    text, edited, other = b"abcde\n" * 40_000, b"abcde\n" * 30_000 + b"other words\n" * 10, b"quite another line\n" * 40_000
    v, e = fingerprint.vector(text), fingerprint.vector(edited)
    assert fingerprint.likeness(v, e) > 0.99 > 0.5 > fingerprint.likeness(v, fingerprint.vector(other))
    half = fingerprint.vector(b"abcde\n" * 20_000)
    assert fingerprint.text_of(fingerprint.add(half, half)) == fingerprint.text_of(v)
    assert fingerprint.text_of(fingerprint.add(v, half, -1)) == fingerprint.text_of(half)


def test_near_copies_share_no_window(spark, tmp_path):
    words = [f"word{i}" for i in range(120)]
    near = [" ".join(words), " ".join(words[:-1]), " ".join(words).replace("word60 ", "other ")]
    texts = near + [None] + [" ".join(f"x{k}y{i}" for i in range(120)) for k in range(3)]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(None, near[0], "a"), (None, near[0], "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("alone"))
    cluster = {(r.doc_id, r.source): r.cluster for r in queries.clustered(docs, rows).collect()}
    assert len(cluster) == 9 and cluster[0, "s0"] == cluster[1, "s1"] == cluster[2, "s2"] and cluster[None, "a"] == cluster[None, "b"]
    assert len(set(cluster.values())) == 6
    windows = [r.bin_id for r in queries.op4_packing(spark, str(tmp_path)).collect() if r.doc_id in (0, 1, 2)]
    assert len(windows) == len(set(windows)) == 3


def test_bpe_digests(spark):
    sf = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(_vocabulary("byte_bpe_50k.json"))
    lib.no_truncation()
    lib.no_padding()
    got = {r.doc_id: r for r in queries.op2_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_a_shared_dictionary_compresses_short_documents(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 2000")
    path = token_store.build(docs, _vocabulary("word_bpe_49k.json"), 2)
    with_one = spark.read.parquet(f"{path}/blocks").selectExpr("sum(length(frames)) n").first().n
    alone = sum(len(zstandard.compress(np.frombuffer(bytes(r.ids), "<u4").astype("<u2").tobytes(), 3)) for r in token_store.read_store(spark, path).collect())
    assert with_one < 0.95 * alone


def _plain_features(t):
    words, lines = t.split(), [x for x in t.split(b"\n") if x]
    same, runs = [a == b for a, b in zip(words, words[1:])], [0]
    for e in same:
        runs.append(runs[-1] + 1 if e else 0)
    size = max(len(t), 1)
    of = lambda chars: sum(b in chars for b in t)
    upper, symbols = of(bytes(range(65, 91))), of(b"#$%&*@^~<>{}[]\\=")
    first = [len(t), len(words), sum(map(len, words)) / max(len(words), 1), len(set(words)) / max(len(words), 1), sum(same) / max(len(words), 1), max(runs), len(lines), len(set(lines)) / max(len(lines), 1)]
    return first + [upper / size, of(b"0123456789") / size, of(b"|") / size, of(b"!") / size, symbols / size, of(b".") / size, of(b",") / size, of(bytes(range(128, 256))) / size, upper, of(b"|"), of(b"!"), symbols]


def test_quality_scores_are_sums_of_table_entries(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 300").unionByName(spark.createDataFrame([(-1, None, None, None, 0), (-2, "", "", "", 0), (-3, "A! A! a|a\n\nx é #", "", "", 0)], spark.read.parquet(f"{sf}/documents.parquet").schema))
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    place = lambda x, edges: sum(e <= x for e in edges)
    for d, t in texts.items():
        x = _plain_features(t)
        margin = model.base + sum(table[place(v, e)] for v, e, table in zip(x, model.edges, model.tables))
        margin += sum(table[place(x[i], model.coarse[i]), place(x[j], model.coarse[j])] for (i, j), table in zip(model.pairs, model.pair_tables))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)
    twice = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.score(docs.filter("doc_id < 0"), quality.fit(docs, twice)).count() == 3  # ties and repeats in the labels


def _plain_best_fit(pieces, capacity, quota):
    """Pieces of one cluster and length are placed in one walk over the bins as they were; a bin takes at most one of them."""
    bins, out, i = [], [None] * len(pieces), 0
    while i < len(pieces):
        size, _, cluster = pieces[i]
        j = i + 1
        while cluster >= 0 and j < len(pieces) and pieces[j][2] == cluster and pieces[j][0] == size:
            j += 1
        waiting, moved = list(range(i, j)), []
        for room, b in sorted((x["room"], b) for b, x in enumerate(bins) if x["room"] >= size):
            k = next((k for k in waiting if (cluster < 0 or cluster not in bins[b]["clusters"]) and (pieces[k][1] < 0 or bins[b]["sources"][pieces[k][1]] < quota)), None)
            if k is not None:
                waiting.remove(k)
                out[k] = (b, capacity - room)
                moved.append((b, k))
            if not waiting:
                break
        for k in waiting:
            bins.append({"room": capacity, "clusters": set(), "sources": Counter()})
            out[k] = (len(bins) - 1, 0)
            moved.append((len(bins) - 1, k))
        for b, k in moved:
            bins[b]["room"] -= size
            bins[b]["clusters"].add(cluster)
            bins[b]["sources"][pieces[k][1]] += 1
        i = j
    return out


def test_best_fit_equals_a_plain_one():
    rnd = random.Random(12)
    for _ in range(150):
        n = rnd.randint(1, 70)
        pieces = sorted(((rnd.randint(1, 40), rnd.randint(-1, 3), rnd.choice([-1, -1, rnd.randint(0, 5)])) for _ in range(n)), key=lambda p: (-p[0], p[2]))
        assert packing.best_fit([p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], 50, 2) == _plain_best_fit(pieces, 50, 2)


def test_packing_takes_empty_sources(spark):
    rows = [(1, "", 1, 30), (2, "", 2, 30), (3, None, 3, 30), (4, "", 4, 30), (5, "", 5, 30), (6, "", 6, 30), (6, "", 6, 30)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long")).collect()
    assert len(got) == 7 and max(Counter(r.bin_id for r in got if r.source == "").values()) <= packing.QUOTA
    assert len({r.bin_id for r in got if r.doc_id == 6}) == 2  # repeated rows are copies of each other


def test_encoder_cuts_texts_into_units_without_changing_ids():
    """distinct units of many texts are looked up at once, in ids and counts as the library gives them."""
    path, rnd = _vocabulary("word_bpe_49k.json"), random.Random(5)
    own, lib = token_store.ChunkEncoder(path, chunks=500), Tokenizer.from_file(path)
    parts = ["'s", "'", "s", "re", "A", "q", "é", "É", "ß", "İ", "Σ", "́", "̇", "1", "23", "²", ".", ",", "--", '"', "«", "—", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "\x00", "\x1c", "<", "|", "<|"]
    parts += ["|>", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "ไม่", "😀", "‍", "ﬁ", "K", "ǅ", "The", "hello", "_", "\xad", "</w>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["", None, "<", "|x", "a<", "|b"]
    for batch in common.slices([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})], "text", 20_000):
        (ids, bounds), counts = own.encode_all(*common.flat(batch), 2), own.count_all(*common.flat(batch))
        for k, t in enumerate(batch.column("text").to_pylist()):
            want = lib.encode(t or "", add_special_tokens=False).ids
            assert (ids[bounds[k] : bounds[k + 1]].tolist(), counts[k]) == ([*want, 2], len(want)), repr(t)


def test_encoder_asks_the_model_once_for_a_word():
    """neither capitals nor marks beside a word make it a new one."""
    own = token_store.ChunkEncoder(_vocabulary("word_bpe_49k.json"))
    asked, model = [], own.tokenize
    own.tokenize = lambda word: asked.append(word) or model(word)
    batch = pa.RecordBatch.from_pydict({"text": ["Zorblat zorblat, ZORBLAT. (zorblat) zorblat! 77zorblat-zorblat", "zorblat?"]})
    own.encode_all(*common.flat(batch), 2)
    assert asked.count("zorblat") == 1


def test_counts_merge_fresh_words_at_once():
    """counts of fresh words come from merging them together, as many ids as the library gives, without a call of its model for each."""
    path, rnd = _vocabulary("word_bpe_49k.json"), random.Random(6)
    own, lib = token_store.ChunkEncoder(path), Tokenizer.from_file(path)
    words = ["".join(rnd.choice("aaabcdeeehinorstt" + "éßüñĳ" * (k % 3 == 0)) for _ in range(rnd.choice([1, 2, 3, 7, 9, 14, 30, 33, 60]))) for k in range(3000)]
    words += [c * n for c in "aeéz" for n in (1, 2, 3, 4, 5, 8, 15, 16, 17, 31, 32)] + ["the", "The", "understanding"]
    asked, model = [], own.tokenize
    own.tokenize = lambda word: asked.append(word) or model(word)
    counts = own.count_all(*common.flat(pa.RecordBatch.from_pydict({"text": words})))
    assert counts.tolist() == [len(lib.encode(w, add_special_tokens=False).ids) for w in words]
    assert all(len(w.encode()) > 32 for w in map(str, asked) if w.isascii()) and len(asked) < len(words) / 2
