"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, embedding_dedup, fill_middle, fingerprint, language, license_scan, lm_score, near_dedup, packing, pii, quality, source_audit, token_store
from marketlens.llm.common import fold, read, written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as a token store and read it back."""
    path = token_store.build(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, decode the ids, and digest both."""
    path = _vocabulary("byte_bpe_50k.json")
    out = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, at three words and 0.85."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=3, threshold=0.85)


def clustered(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows``, of documents' (doc_id, alone, ...), with their near-duplicate component as cluster; without an id, ``alone``."""
    groups = near_dedup.near_duplicates(documents, words=5, threshold=0.8).filter("doc_id is not null")
    groups = written(groups.groupBy("doc_id").agg(F.min("component_id").alias("cluster")), "clusters")
    return rows.join(groups, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "alone")).drop("alone")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens, near copies (five words, 0.8) and crowding sources kept apart."""
    documents = read(spark, sf_dir, "documents")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("alone"))
    counts = written(token_store.token_counts(texts, _vocabulary("word_bpe_49k.json"), ["source", "alone"]), "token-counts")
    return packing.pack(written(clustered(documents, counts), "clustered"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a context tree learned from six of seven folds."""
    documents, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 7) == 2
    scored = lm_score.score(documents, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.compare_edits(read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three of four folds."""
    documents, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    learned = language.sample(documents, ~held_out)
    return language.predict(documents, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from four of five folds of the labels."""
    documents, held_out = read(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = quality.fit(documents, read(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    out = pii.spans(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *(pii.count("base", k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("all").alias("spans"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's word use lies from that of the others of its language."""
    return source_audit.audit(read(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-middle examples, and turned back."""
    out = fill_middle.transform(read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    restored = fill_middle.restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    out = license_scan.scan(read(spark, sf_dir, "documents"))
    first, last = F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word")
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), first, last, license_scan.labels("places").alias("base_labels"), license_scan.labels("places", "matches").alias("labels"), license_scan.score().alias("score"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_bpe": op2_bpe,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_lm_score": op5_lm_score,
    "op6_fingerprint": op6_fingerprint,
    "op7_language": op7_language,
    "op9_quality": op9_quality,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op10_pii": op10_pii,
    "op11_source_audit": op11_source_audit,
    "op12_fill_middle": op12_fill_middle,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op11_source_audit": r"""
WITH docs AS (SELECT row_number() OVER () id, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{80}-\x{10FFFF}]+') words FROM documents),
words AS (SELECT id, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term FROM docs),
kept AS (SELECT lang, term, count(*) n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) v, sum(n) total FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, count(*) n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) total FROM used GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
sums AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source item, coalesce(s.value, 0) value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) rank FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op12_fill_middle": r"""
WITH draws AS (SELECT doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) h FROM documents),
numbers AS (SELECT doc_id, text, t, len(t) n, ('0x' || h[1:8])::BIGINT h1, ('0x' || h[9:16])::BIGINT h2, ('0x' || h[17:24])::BIGINT h3, ('0x' || h[25:32])::BIGINT h4 FROM draws),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM numbers),
pieces AS (SELECT *, array_to_string(t[1:a], '') pre, array_to_string(t[a + 1:b], '') mid, array_to_string(t[b + 1:n], '') suf FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM pieces
""",
}
