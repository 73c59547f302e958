"""Each operator against a plain version of itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import bpe, embedding_dedup, fingerprint, language, near_dedup, packing, pii, quality, queries, token_store
from marketlens.llm.common import fold
from marketlens.llm.graph import components
from marketlens.llm.queries import _vocabulary

WORDS, BYTES = _vocabulary("word_bpe_49k.json"), _vocabulary("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", "a", "the", "é", "Σ", "ΑΣ", "İ", "é", "1", "٣", "²", "中文", "😀", "\x1c", "\x85", "\xa0", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "^", "ß", "ſ", ".", "!!!", "ﬁ", "Ⅷ", "_", "a" * 90, "abab" * 40, "K"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return {r.doc_id: r for r in docs.collect()}


def _mixture(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_the_library():
    own, lib = bpe.codec(BYTES), Tokenizer.from_file(BYTES)
    for t in _mixture(1500):
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert own.decode(ids) == lib.decode(ids.tolist(), skip_special_tokens=False)


def test_long_words_merge_alike():
    own, rnd = bpe.codec(BYTES), random.Random(1)
    for _ in range(60):
        word = "".join(rnd.choice("abcdetins") for _ in range(rnd.randint(2, 60))).encode()
        parts = [own.bytes[b] for b in word]
        assert own._scan(list(parts)) == own._heap(list(parts))


def test_chunks_equal_the_library():
    own, lib = token_store.encoder(WORDS), Tokenizer.from_file(WORDS)
    for t in _mixture(1500, 4):
        assert np.frombuffer(own.encode(t), own.type).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_store_round_trip(spark, sf, docs, local):
    lib, start = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: r for r in queries.op1_token_output(spark, sf).collect()}
    for d in sorted(local):
        ids = lib.encode(local[d].text, add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = token_store.build(docs, WORDS, 2)
    some = {r.doc_id: bytes(r.ids) for r in token_store.read_store(spark, path, [3, 77]).collect()}
    assert set(some) == {3, 77} and zlib.crc32(some[77]) == got[77].ids_crc32


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[100] == got[101] == 100


def _sets(local, words):
    def one(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    return {d: one(t) for d, t in local.items()}


def _groups(ids, links):
    home = {i: i for i in ids}

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        home[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("words,threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates(spark, local, words, threshold):
    rnd, texts = random.Random(2), {d: r.text for d, r in local.items()}
    base = list(texts.values())[5].split()[:150]
    for k in range(40):  # a chain of edits, and short texts
        w = list(base)
        for _ in range(k % 13):
            w[rnd.randrange(len(w))] = f"new{rnd.random()}"
        texts[1000 + k] = " ".join(w)
        texts[2000 + k] = " ".join(base[: 1 + k % 4])
    sets = _sets(texts, words)
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= round(threshold * 100) * len(sets[a] | sets[b])]
    want = _groups(sets, pairs)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words, threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


def test_blocks_lose_no_link(monkeypatch, spark, local):
    from marketlens.llm import tiles

    texts = {d: r.text for d, r in local.items()} | {3000 + k: f"one two three four five six seven eight nine ten {k % 7} eleven twelve thirteen fourteen {k}" for k in range(50)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, 3, 0.5).collect()}
    limited = tiles.dealt
    monkeypatch.setattr(tiles, "dealt", lambda m, k, i, **kw: limited(m, k, i, limit=5, **(kw | {"weight_limit": 400} if kw else kw)))
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, 3, 0.5).collect()} == whole


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 1 << 63, 2000).astype(np.uint64)
    for share in (0.8, 0.9, 0.97):
        b = np.concatenate([a[: int(2000 * share)], rnd.integers(0, 1 << 63, 2000 - int(2000 * share)).astype(np.uint64)])
        real = share / (2 - share)
        _, odd = near_dedup.sketch([np.unique(a), np.unique(b)], 4)
        words = odd.view(np.uint64)
        assert abs(float(near_dedup.estimates(words[0], words[1])) - real) < 0.12


def _naive_best_fit(pieces, capacity, quota):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and (cluster < 0 or cluster not in b["clusters"]) and (source < 0 or b["sources"][source] < quota)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "clusters": set(), "sources": Counter()})
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= size
        bins[i]["clusters"].add(cluster)
        bins[i]["sources"][source] += 1
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rnd = random.Random(9)
    for _ in range(60):
        pieces = sorted(((rnd.randint(1, 40), rnd.randint(-1, 3), rnd.choice([-1, -1, rnd.randint(0, 5)])) for _ in range(80)), key=lambda p: (-p[0], p[2]))
        got = packing.best_fit([p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], 50, 2)
        held, names = defaultdict(list), defaultdict(list)
        for (b, at), p in zip(got, pieces):
            held[b].append((at, p[0]))
            names[b].append(p)
        for b, spans in held.items():
            end = 0
            for at, size in sorted(spans):
                assert at == end
                end = at + size
            assert end <= 50
            clusters = [c for _, _, c in names[b] if c >= 0]
            assert len(clusters) == len(set(clusters))
            assert all(n <= 2 for s, n in Counter(s for _, s, _ in names[b]).items() if s >= 0)
        assert abs(len(held) - len({b for b, _ in _naive_best_fit(pieces, 50, 2)})) <= 1
    alone = sorted(((rnd.randint(1, 40), -1, -1) for _ in range(200)), key=lambda p: -p[0])
    assert packing.best_fit([p[0] for p in alone], [-1] * 200, [-1] * 200, 50, 2) == _naive_best_fit(alone, 50, 2)


def test_packing_keeps_all_tokens(spark, sf):
    got = queries.op4_packing(spark, sf).collect()
    counts = {r.doc_id: r.n_tokens for r in token_store.token_counts(spark.read.parquet(f"{sf}/documents.parquet"), WORDS).collect()}
    total = Counter()
    for r in got:
        total[r.doc_id] += r.piece_tokens
    assert total == Counter(counts)


def test_fingerprint_is_homomorphic(spark, sf, local):
    a, b, c = b"first paragraph here", b"second one", b"third and last of them"
    v = fingerprint.vector
    same = lambda p, q: fingerprint.text_of(p) == fingerprint.text_of(q)
    assert same(v(b"\n".join([a, b, c])), v(b"\n".join([c, a, b])))
    assert same(fingerprint.add(v(a), v(b)), v(a + b"\n" + b)) and same(fingerprint.add(v(a + b"\n" + c), v(c), -1), v(a))
    assert not same(v(a + b"\n" + a), v(a))
    order = sorted(local)
    got = {r.doc_id: r for r in fingerprint.compare_edits(spark.read.parquet(f"{sf}/documents.parquet"), parts=5).collect()}
    for k, d in enumerate(order):
        text, nxt = local[d].text, local[order[(k + 1) % len(order)]].text
        cut = len(text) // 4
        edited = (text[: len(text) - cut] + nxt[:cut]).encode()
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited).hexdigest()
        assert got[d].fingerprint == fingerprint.text_of(v(text.encode())) and got[d].edited_fingerprint == fingerprint.text_of(v(edited))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.99


def _phrases(symbols, sample):
    text = "".join(map(chr, sample))
    n, at = 0, 0
    while at < len(symbols):
        k = 1
        while at + k <= len(symbols) and "".join(map(chr, symbols[at : at + k])) in text:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_counts_phrases():
    samples = [("aa", ["lorem ipsum dolor sit amet consectetur"]), ("bb", ["the quick brown fox jumps over the lazy dog"])]
    m = language.Model(samples)
    texts = ["the lazy fox", "dolor sit", "qqq the", "zz"]
    seqs = [m.symbols(language.normal(t)) for t in texts]
    got = m.phrases(seqs)
    for j, (_, ts) in enumerate(samples):
        sample = m.symbols(np.concatenate([language.normal(t + " ") for t in ts])).tolist()
        for i, s in enumerate(seqs):
            assert got[i, j] == _phrases(s.tolist(), sample)
    assert m.predict([b"the lazy dog", b"ipsum dolor", b"", b"123"])[0] == ["bb", "aa", "und", "und"]


def test_long_texts_are_parsed_as_one(monkeypatch):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(200)]
    letters = [chr(0x4E00 + i) for i in range(3000)] + [chr(0x20000 + i) for i in range(300)]
    some = lambda n, ws: " ".join(rnd.choice(ws) for _ in range(n))
    samples = [("aa", [some(1500, words)]), ("bb", [some(700, words[::2]), "aaaa " * 50]), ("zz", ["".join(rnd.choice(letters) for _ in range(6000))])]
    texts = [some(2000, words), "a" * 4000, "aaaa " * 900, "".join(rnd.choice(letters) for _ in range(2500)), "q", some(100, words), "x" * 600, samples[0][1][0][100:7000], "aaaa " * 205]
    m = language.Model(samples)
    seqs = [m.symbols(language.normal(t)) for t in texts]
    assert max(map(len, seqs)) > 10_000
    for window in (language.WINDOW, 1500):
        monkeypatch.setattr(language, "WINDOW", window)
        got = m.phrases(seqs)
        for j, (_, ts) in enumerate(samples):
            sample = m.symbols(np.concatenate([language.normal(t + " ") for t in ts])).tolist()
            assert got[:, j].tolist() == [_phrases(s.tolist(), sample) for s in seqs]


def test_languages_of_one_large_alphabet():
    rnd = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    tongues = [[rnd.choice(letters) + rnd.choice(letters) for _ in range(6000)] for _ in range(2)]
    m = language.Model([(f"l{k}", ["".join(rnd.choice(t) for _ in range(15_000))]) for k, t in enumerate(tongues)])
    texts = [(k, "".join(rnd.choice(tongues[k]) for _ in range(10))) for k in (0, 1) for _ in range(60)]
    assert np.mean([m.predict([t.encode()])[0][0] == f"l{k}" for k, t in texts]) > 0.98


def test_many_languages_share_the_bound(spark):
    rows = [(i, f"{chr(0x4E00 + i % 1500)} words of language {i % 1500}", f"l{i % 1500:04}") for i in range(3000)]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), total=15_000)
    assert len(got) == 1500 and sum(len(t) for _, ts in got for t in ts) <= 30_000


def test_language_and_quality_learn(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.op7_language(spark, sf).collect() if r.held_out]
    assert len(got) > 200 and np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.98
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op9_quality(spark, sf).collect() if r.held_out and r.doc_id in marks]
    assert np.mean([marks[r.doc_id] == r.predicted for r in got]) > 0.88 and np.mean([r.predicted for r in got if marks[r.doc_id]]) > 0.97


def test_gam_uses_a_pair():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.Gam(x, y)
    assert {0, 1} in [set(p) for p in m.pairs] and np.mean((m.score(x) > 0.5) == y) > 0.9


def test_embeddings(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for dim in (16, 3, 40):  # vectors of different lengths in one table
        x = rnd.standard_normal((200, dim))
        rows += [*x, *(x[:60] + 0.12 * rnd.standard_normal((60, dim))), *(x[:40] + 0.45 * rnd.standard_normal((40, dim))), *x[:5], *(x[7:12] * 1e-200), *(x[7:12] * 1e200)]
    rows += [np.array([2.0]), np.array([3.0]), np.array([-1.0])]
    rnd.shuffle(rows)
    link = np.zeros((len(rows), len(rows)), bool)
    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            if len(x) == len(y):
                u, v = x / np.abs(x).max(), y / np.abs(y).max()
                link[i, j] = link[j, i] = u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.9
    want = _groups(range(len(rows)), list(zip(*np.nonzero(link))))
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(link[i].sum()), want[i]) for i in range(len(rows))}


def test_pairs_in_doubt_are_computed_again():
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((300, 24))
    x[150:] = x[:150] + 0.47 * rnd.standard_normal((150, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = dict(zip("qsae", embedding_dedup.quantised(x)))
    pairs: dict = {}
    embedding_dedup.judged(side, side, 0.9, lambda i, j, sure: pairs.update(zip(zip(i.tolist(), j.tolist()), sure.tolist())))
    real = x @ x.T
    assert all((i, j) in pairs for i, j in zip(*np.nonzero(real >= 0.9))) and all(real[p] >= 0.9 for p, sure in pairs.items() if sure)
    assert 0 < sum(not s for s in pairs.values()) < 600


def test_quantisation_bound_holds():
    rnd = np.random.default_rng(6)
    u = rnd.standard_normal((200, 32))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, near, err = embedding_dedup.quantised(u)
    guess = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - guess) <= near[:, None] * err[None, :] + err[:, None] + 1e-6).all()


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum((lambda x: x - 9 if x > 9 else x)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def _base(t):
    found = [(m.start(), r, m.end(), k) for r, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, t) if _valid(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_personal_data(spark, local):
    rnd = random.Random(5)
    parts = ["a", "b@c.d", "@", ".", "1", "22", "255", "256", ".1.2.3", "4", "-", " ", "+1", "(", "555", "é", "😀", "\n", "4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485", "x.y%z", "000"]
    texts = [r.text for r in local.values()] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(800)] + ["9" * 5000, "a" * 50000, "1.2.3.4 " * 9000, "x@y.zz " * 130]
    got = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.joined("base").alias("b")).collect()
    assert {r.doc_id: r.b for r in got} == {i: _base(t) for i, t in enumerate(texts)}


def _spans_of(spark, rows):
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(frame).select("doc_id", pii.joined("base").alias("b"), pii.joined("all").alias("a")).collect()}
    return frame, [got[i].b for i in range(len(rows))], [got[i].a for i in range(len(rows))]


def test_contexts_give_unseen_identifiers_away(spark):
    rows = [f"please phone +1 (20{k}) 555-010{k} tonight" for k in range(8)] + ["please phone 030-1234-567 tonight", "please phone 030 1234 567 tonight", "there are 1200345678 stars in sight"]
    frame, base, every = _spans_of(spark, rows)
    assert base[8:] == ["", "", ""] and every[8:] == ["phone:13:25", "phone:13:25", ""]
    red = {r.doc_id: r.text for r in pii.redacted(frame).collect()}
    assert red[0] == red[8] == red[9] == "please phone [PHONE] tonight" and red[10] == rows[10]


def test_rounds_go_on_while_something_is_found(spark):
    rnd = random.Random(3)
    hexed = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n - 2)) + "a7"
    rows = [f"w{k % 3} token = \"{hexed(40)}\" end{k % 4}" for k in range(30)]  # seeds
    rows += [f"my session={hexed(40)}; ok" for _ in range(12)]  # found by shape, which makes the key a pattern
    rows += [f"my session=Q{rnd.randint(10**7, 10**8 - 1)}; ok" for _ in range(4)]  # found by that key and the neighbours
    rows += ["version 2.0 of 1984", "the key session=on", "section 12b, page 77", None]
    _, base, every = _spans_of(spark, rows)
    assert set(base) == {""} and all(s.startswith("secret:") for s in every[:46]) and every[46:] == ["", "", "", ""]
    at = rows[45].index("Q")
    assert every[45] == f"secret:{at}:{at + 9}"


def _plain_graph(edges):
    kinds, links, facts = {}, defaultdict(set), {}
    for value, kind, digits, at, mixed, luhn, pattern in edges:
        if kind is not None:
            kinds[value] = min(kind, kinds.get(value, kind))
        links[value].add(pattern)
        facts[value] = (digits, at, mixed, luhn)
    allowed = {"email": lambda d, a, m, u: a, "ip": lambda d, a, m, u: 4 <= d <= 12, "card": lambda d, a, m, u: u, "phone": lambda d, a, m, u: 7 <= d <= 15, "secret": lambda d, a, m, u: m}
    beliefs, total = {}, 0.0
    while True:
        known, unknown = defaultdict(Counter), defaultdict(list)
        for value, patterns in links.items():
            for p in patterns:
                if value in kinds:
                    known[p][kinds[value]] += 1
                else:
                    unknown[p].append(value)
        sure = defaultdict(dict)
        for p, counts in known.items():
            for k, n in counts.items():
                c = round(n / (sum(counts.values()) + pii.DOUBT * sum(1 - beliefs.get((v, k), 0) for v in unknown[p] if allowed[k](*facts[v])) + 1), 6)
                if n >= pii.SUPPORT and c >= pii.PRECISION:
                    sure[p][k] = c
        fresh, beliefs = {}, {}
        for value, patterns in links.items():
            against = defaultdict(float)
            for p in patterns:
                for k, c in sure[p].items():
                    if value not in kinds and allowed[k](*facts[value]):
                        against[k] += math.log1p(-c)
            best = min(((round(x, 6), k) for k, x in against.items()), default=(0.0, None))
            if math.exp(best[0]) <= 1 - pii.ACCEPT:
                fresh[value] = best[1]
            else:
                beliefs |= {(value, k): 1 - math.exp(round(x, 6)) for k, x in against.items()}
        if not fresh and sum(beliefs.values()) <= total * (1 + pii.SETTLED):
            return kinds
        kinds, total = kinds | fresh, sum(beliefs.values())


def test_the_graph_equals_a_plain_one(spark):
    rnd, edges = random.Random(11), set()
    for v in range(400):
        group = v % 5
        kind = ["email", "ip", "card", "phone", "secret"][group if rnd.random() < 0.97 else v % 4] if rnd.random() < 0.7 else None
        facts = (rnd.choice([3, 8, 12, 16]), rnd.random() < 0.7, rnd.random() < 0.7, rnd.random() < 0.7)
        for _ in range(rnd.randint(1, 5)):
            edges.add((v, kind, *facts, f"p{group}{rnd.randint(0, 3)}" if rnd.random() < 0.8 else f"p{rnd.randint(0, 60)}"))
        if rnd.random() < 0.1:
            edges.add((v, "phone", *facts, f"p{group}0"))
    frame = spark.createDataFrame(sorted(edges, key=str), "value long, kind string, digits int, at boolean, mixed boolean, luhn boolean, pattern string")
    want = _plain_graph(edges)
    assert {r.value: r.kind for r in pii.accepted(frame).collect()} == want and len(want) > len({e[0] for e in edges if e[1]})


def test_planted_secrets_are_found(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {d: {m.span(1) for m in re.finditer(r"(?:password=|token = \")([0-9a-f]+)", t)} | {m.span() for m in re.finditer(r"\bAKIA[A-Z0-9]{12,}", t)} for d, t in texts.items()}
    found: dict = {}
    for r in queries.op10_pii(spark, sf).collect():
        extra = Counter(r.spans.split(",")) - Counter(_base(texts[r.doc_id]).split(","))
        found[r.doc_id] = {tuple(map(int, x.split(":")[1:])) for x in extra if x}
    hits, wanted = sum(len(want[d] & found[d]) for d in want), sum(map(len, want.values()))
    assert wanted and hits / wanted > 0.95
    for d, spans in found.items():  # and nothing else, but cards that stand next to each other
        assert all(_valid("card", texts[d][a:b]) for a, b in spans - want[d])


def test_half_of_the_seeds_give_the_other_half_away(spark):
    """Half of the known values are taken for unknown; the patterns of the others bring nearly all of them back, under their kind."""
    scan = pii._scanned(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    graph = scan.select(F.explode("seen").alias("s")).select("s.*")
    edges = graph.select("value", "kind", "digits", "at", "mixed", "luhn", F.explode("patterns").alias("pattern")).distinct()
    hidden = F.pmod(F.xxhash64("value", F.lit(5)), F.lit(2)) == 0
    want = {r.value: r.kind for r in edges.filter(hidden & F.col("kind").isNotNull()).groupBy("value").agg(F.min("kind").alias("kind")).collect()}
    got = {r.value: r.kind for r in pii.accepted(edges.withColumn("kind", F.when(~hidden, F.col("kind")))).collect()}
    shown = {r.value for r in edges.filter(~hidden & F.col("kind").isNotNull()).select("value").distinct().collect()}
    for kind in (*pii.KINDS, pii.SECRET):
        mine = [v for v, k in want.items() if k == kind]
        found = [v for v in got if got[v] == kind and v not in shown]
        recall, precision = sum(got.get(v) == kind for v in mine) / len(mine), sum(want.get(v) == kind for v in found) / len(found)
        print(kind, len(mine), round(recall, 3), round(precision, 3))
        assert len(mine) > 50 and recall >= 0.9 and precision >= 0.9, (kind, recall, precision)


def test_a_key_is_learned(spark):
    """No key is known beforehand: values that look random seed it, and it then gives away values that don't."""
    rnd = random.Random(8)
    rows = [f"set vault_pass: {''.join(rnd.choice('0123456789abcdef') for _ in range(31))}a7 now" for _ in range(20)]
    rows += [f"set vault_pass: horse{k}battery now" for k in range(5)] + ["turn volume: level7up please", "set vault_pass: none now"]
    _, _, every = _spans_of(spark, rows)
    assert all(s.startswith("secret:16:") for s in every[:25]) and every[25:] == ["", ""]


def test_folds(spark):
    got = spark.range(50).select("id", fold("id", 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)
