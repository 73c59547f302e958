"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import bpe, embedding_dedup, fill_middle, fingerprint, language, license_scan, lm_score, near_dedup, packing, pii, quality, source_audit, token_store
from marketlens.llm.queries import _vocabulary

WORDS, BYTES = _vocabulary("word_bpe_49k.json"), _vocabulary("byte_bpe_50k.json")
EXTRA = ["score", "h", "base", "member", "lang_pred", "component", "bin_id", "row", "x", "y", "key", "n", "word", "all", "cluster", "kept", "_t", "place", "n_tokens", "ids", "features", "term", "p", "output", "form", "matches", "places", "labels", "side", "block"]


def _docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="module")
def edge(spark):
    long = "the quick brown fox jumps over lazy dogs " * 3000
    rows = [
        (1, "hello world again and again, mail a.b@c.example now", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "a text without an id", "en", "b", 3), (4, "   \n\t ", "en", "a", 3),
        (5, long, "en", "a", 1), (5, "the id five again", None, "c", 1), (1, "hello world again and again, mail a.b@c.example now", "en", "a", 5), (6, "x", "fr", "a", 1), (7, "7 7 7", "fr", "b", 5),
        (8, "où est la gare s'il vous plaît monsieur", "fr", "b", 5), (9, "9" * 3000, None, None, None), (None, None, None, None, None),
    ]
    return _docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 0), (6, None, 0), (7, 1, None), (8, 1, 0)], "doc_id long, quality int, toxic int")


RUNS = {
    "token_store": lambda s, d: token_store.read_store(s, token_store.build(d, WORDS, 2)),
    "bpe": lambda s, d: bpe.decode(bpe.encode(d, BYTES), BYTES),
    "near_dedup": lambda s, d: near_dedup.near_duplicates(d),
    "lm_score": lambda s, d: lm_score.score(d, F.lit(True)),
    "fingerprints": lambda s, d: fingerprint.fingerprints(d),
    "compare_edits": lambda s, d: fingerprint.compare_edits(d),
    "language": lambda s, d: language.predict(d, language.sample(d, F.lit(True))),
    "quality": lambda s, d: quality.score(d, quality.fit(d, _labels(s))),
    "pii": lambda s, d: pii.spans(d),
    "redacted": lambda s, d: pii.redacted(d),
    "fill_middle": lambda s, d: fill_middle.transform(d),
    "license_scan": lambda s, d: license_scan.scan(d),
    "token_counts": lambda s, d: token_store.token_counts(d, WORDS, ["source"]),
    "packing": lambda s, d: packing.pack(d.select("doc_id", "source", F.xxhash64("text").alias("cluster"), F.length("text").cast("long").alias("n_tokens")), capacity=1 << 20).filter("piece = 0"),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_comes_back(spark, edge, name):
    assert RUNS[name](spark, edge).count() == 13


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, empty, name):
    assert RUNS[name](spark, empty).count() == 0


def test_source_audit_takes_odd_rows(spark, edge, empty):
    assert source_audit.audit(empty).count() == 0
    got = source_audit.audit(edge, least_documents=2).collect()
    assert {(r.lang, r.source) for r in got if r.part == "pair"} == {(a, b) for a, b in (("", ""), ("", "c"), ("en", "a"), ("en", "b"), ("fr", "a"), ("fr", "b"))}
    assert all(r.value == 0 and r.rank == 1 for r in got if r.lang in ("", "fr"))  # no term is in two of their documents
    assert {r.item for r in got if r.part == "term" and r.source == "a"} <= {"hello", "world", "again", "and", "mail", "a", "b", "c", "example", "now"}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, edge, empty, tmp_path, stage):
    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, edge, str(tmp_path))
    assert out.count() > 0
    assert stage == "packing" or out.columns == edge.columns
    assert run(spark, empty, str(tmp_path)).count() == 0


def test_near_dedup_stage_drops_repeated_rows(spark, edge):
    out = corpus_pipeline.near_duplicates(spark, edge, "").collect()
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in out if r.doc_id in (1, 5)) == [(1, "hello"), (5, "the i"), (5, "the q")]
    assert sum(r.doc_id is None for r in out) == 2 and list(out[0].asDict()) == edge.columns


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 1.0]), (10, []), (None, [1.0, 0.0]), (9, [-1.0, 0.0]), (11, [1.0]), (12, [5.0, 1.0, 0.0]), (13, [5.0, 1.0, 0.0]), (14, [5.0, 1.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in EXTRA})
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (9, 0, 9, True)} <= got
    assert all((i, 0, i, True) in got for i in (4, 5, 6, 7, 8, 10, 11))
    assert {(12, 2, 12, True), (13, 2, 12, False), (14, 2, 12, False), (None, 0, None, True)} <= got
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_worker_keeps_what_one_operator_needs():
    """Workers serve the stages one after the other; a later one's memory comes in place of an earlier one's."""
    import gc
    import weakref

    import public_tokenizers

    from marketlens.llm import language, near_dedup, token_store

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = weakref.ref(token_store.encoder(path, 100, 100))
    assert token_store.encoder(path, 100, 100) is encoder()
    near_dedup.shingle_sets([b"a b c"], 2)
    gc.collect()
    assert encoder() is None
    layout = language._lanes([language.Model([("x", ["abc"])]).symbols(language.normal("a bc"))])
    assert layout["steps"].dtype == "int64"  # what automata are stepped with
