"""The corpus pipeline: language ID, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gets what the stage before it kept, written as Parquet and read again. All
but the last return the columns of ``documents``; the last returns the pieces of documents with their windows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import language, near_dedup, packing, pii, quality, token_store
from marketlens.llm.common import parted, read, written

#: SQL has no word for most of these stages; they are tested against plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is in one of the languages that the corpus labels."""
    return language.accepted(docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality model, fitted on the labels, scores at 0.3 or more."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group (five words, 0.8).

    Of rows that repeat an id and its text one stays; rows of one id with different texts stay or go together. Documents
    without an id stay.
    """
    groups = written(near_dedup.near_duplicates(docs, words=5, threshold=0.8), "pipeline-groups")
    gone = written(groups.filter("not kept").select("doc_id").distinct(), "pipeline-gone")
    some, rest = parted(docs.filter("doc_id is not null"), gone, "doc_id")  # texts that may go are shuffled, the others stay where they are
    named = rest.unionByName(some.join(gone.hint("merge"), "doc_id", "left_anti"))
    again = groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    if again.head(1):  # ids repeat, which is rare: only their rows are compared
        named = named.join(again, "doc_id", "left_anti").unionByName(named.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return named.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into windows of 4096 tokens, keeping crowding sources and equal texts apart."""
    clusters = F.xxhash64(F.coalesce("text", F.lit("")))
    path = public_tokenizers.path("word_bpe_49k.json")
    counts = token_store.token_counts(docs.select("doc_id", "text", "source", clusters.alias("cluster")), path, ["source", "cluster"], chunks=150_000, words=200_000)  # small memos: the workers serve all stages
    return packing.pack(written(counts, "token-counts"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
