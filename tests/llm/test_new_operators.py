"""Source audit, fill-in-middle and license scan against plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import fill_middle, license_scan, queries, source_audit
from marketlens.llm.common import keys_at

LONG = "é" * 40 + "x"
ODD = [
    (1, "The the THE cat", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "no id here cat", "en", "b"), (4, "  \t\n ", "en", "b"), (1, "The the THE cat", "en", "a"), (5, f"{LONG} {LONG}y {LONG} {LONG[:-1]} abcdefgh abcdefghi abcdefgh", "fr", "a"),
    (6, "1 2 3", "fr", "b"), (7, "Straße straße STRASSE İ ı", "de", "a"), (8, "x<P>y z", "de", "a"), (9, "one  two three\x1cfour\x0bfive   ", "de", ""), (10, "words " * 3000, "en", "c"),
]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def rows(spark):
    some = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return some + ODD


def _audit(rows, least, top):
    words = [(g or "", s or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, g, s in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for g, s, w in words:
        df[g].update(set(w))
        count[g, s].update(w)
    out = set()
    for lang in {g for g, _ in count}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = sorted(s for g, s in count if g == lang)
        p = {}
        for s in [*sources, None]:
            c = {t: sum(count[lang, x][t] for x in (sources if s is None else [s])) for t in kept}
            n = sum(c.values())
            p[s] = {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            own = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > p[None][t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(own, 1)}
    return out


@pytest.mark.parametrize("least,top", [(1, 5), (3, 50), (30, 50)])
def test_source_audit(spark, rows, least, top):
    got = [tuple(r) for r in source_audit.audit(_docs(spark, rows).repartition(5), least, top).collect()]
    assert len(got) == len(set(got)) and set(got) == _audit(rows, least, top)


def test_source_audit_in_small_shards_and_blocks(spark, rows, monkeypatch):
    for name, value in (("SHARD", 400), ("BLOCK", 7), ("SIDE", 2)):
        monkeypatch.setattr(source_audit, name, value)
    assert source_audit._pieces(1000, np.frombuffer(b"ab " * 333 + b"x", np.uint8))[1:-1] == [401, 800]
    batch = pa.RecordBatch.from_pydict({"text": ["words " * 3000 + "end"], "lang": ["en"], "source": ["c"]})  # one text, counted in pieces
    assert sorted((r["n"], r["df"], r["term"] or "") for r in source_audit._shard(batch).to_pylist()) == [(1, 1, ""), (1, 1, "end"), (3000, 1, "words")]
    assert {tuple(r) for r in source_audit.audit(_docs(spark, rows), 2, 50).collect()} == _audit(rows, 2, 50)


def test_equal_runs_are_sorted_words():
    rnd = random.Random(1)
    words = [("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) * rnd.choice([1, 1, 3, 9, 30])).encode() for _ in range(3000)]
    data = np.frombuffer(b" ".join(words) + b"\0" * 8, np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    group = np.array([rnd.randrange(3) for _ in words])
    order, heads = source_audit.equal_runs(data, starts, ends, group)
    keyed = [(group[i], words[i]) for i in order]
    assert keyed == sorted(keyed) and [keyed[h] for h in heads] == sorted(set(keyed))
    assert all(a < b for a, b, x, y in zip(order, order[1:], keyed, keyed[1:]) if x == y)
    assert keys_at(data, np.array([0]), np.array([0]))[0] == 0


@pytest.mark.parametrize("name", ["op11_source_audit", "op12_fill_middle"])
def test_same_as_sql(spark, tmp_path, rows, name):
    many = rows * 3  # so that terms are in thirty documents
    _docs(spark, many).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect()) and len(want) > 300


def test_rank_index_is_exact():
    rnd = np.random.default_rng(2)
    for steps in (rnd.integers(1, 12, 5000), rnd.choice([1, 400], 3000), np.array([7]), np.array([], int), np.full(2000, 3), rnd.choice([1, 100_000], 300)):
        offsets = np.cumsum(steps).astype(np.int64)
        index = fill_middle.RankIndex(offsets)
        assert index.offsets(np.arange(len(offsets))).tolist() == offsets.tolist()
        assert not len(offsets) or np.abs(index.residuals).max() <= fill_middle.ERROR
    assert len(fill_middle.RankIndex(np.cumsum(rnd.integers(4, 8, 5000))).firsts) < 20 and len(fill_middle.RankIndex(np.arange(5000) * 3).firsts) == 1


def test_fill_middle(spark, rows):
    got = fill_middle.transform(_docs(spark, rows).repartition(3)).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    want = Counter()
    for i, t, _, _ in rows:
        t = t or ""
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
        pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        out = {"plain": t, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        want[i, len(tokens), form, None if form == "plain" else len(pre), None if form == "plain" else len(mid), out, t] += 1
    assert Counter(tuple(r) for r in got) == want
    assert {"plain", "psm", "spm"} <= {r.form for r in got}


def _scan(text, threshold=0.8):
    """(n_words, places, labels) by trying every block with every template."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for p, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    found = []
    for label, telling, notice in license_scan.TEMPLATES:
        parts, half = notice.split(), 8
        while half < len(parts):
            half *= 2
        for a in range(0, len(words), half):
            block = set(words[a : a + 2 * half])
            share = len(block & set(parts)) / len(set(parts))
            if share >= threshold - 1e-12 and set(telling.split()) <= block:
                found.append((a, min(a + 2 * half, len(words)), label, set(telling.split()), share))
    kept = [m for m in found if not any(m[3] < o[3] and m[0] < o[1] and o[0] < m[1] for o in found)]
    return len(words), places, sorted((a, b, label, round(share, 9)) for a, b, label, _, share in kept)


NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "under the MIT license " * 5, "licensed under the gnu lesser general public license version 3", "MIT mit Mit license under the", "the license of mit's lab", "Dual: under the MIT License or the Apache License, Version 2.0",
    "under\nthe\tmit\x1clicense", "underé the mit license", "cc by nc" * 3, "permission is hereby granted, free of charge, to any person obtaining a copy of this SOFTWARE and associated documentation files (the software), to deal in the software without restriction",
]


def test_license_scan(spark, rows):
    rnd, texts = random.Random(3), list(NOTICES)
    vocabulary = sorted({w for _, _, t in license_scan.TEMPLATES for w in t.split()}) + ["alpha", "beta", "é", "noncommercialx", "x" * 20]
    for _ in range(250):  # notices with words lost, added and put elsewhere
        w = rnd.choice(license_scan.TEMPLATES)[2].split()
        for _ in range(rnd.randint(0, len(w) // 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rnd.shuffle(w) if rnd.random() < 0.3 else None
        texts.append(" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)) + w + rnd.choices(vocabulary, k=rnd.randint(0, 30))))
    every = rows + [(1000 + i, t, "en", "a") for i, t in enumerate(texts)]
    got = license_scan.scan(_docs(spark, every)).collect()
    read = Counter((r.doc_id, r.n_words, tuple(sorted((p.start, p.label) for p in r.places)), tuple(sorted((m.start, m.end, m.label, round(m.containment, 9)) for m in r.matches))) for r in got)
    want = Counter((i, n, tuple(p), tuple(m)) for i, t, _, _ in every for n, p, m in [_scan(t)])
    assert read == want and sum(len(r.matches) for r in got) > 150


def test_license_scan_query(spark, tmp_path):
    texts = NOTICES + [None, "", "nothing of the kind"]
    _docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i].labels for i in (0, 1, 2, 3, 4, 6, 9)] == ["mit", "apache-2", "cc-by-nc", "cc-by", "gpl-3", "lgpl-3", "apache-2,mit"]
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels, got[5].score) == (5, 0, 16, "mit", 1.0)
    assert [(got[i].n_base, got[i].labels) for i in (8, 11)] == [(0, ""), (0, "")]
    for i in (14, 15, 16):
        assert (got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels, got[i].score) == (0, None, None, "", "", 0.0)
