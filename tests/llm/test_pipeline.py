"""The pipeline stage by stage against plain versions."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_brute import _base, _groups, _sets

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 250")
    stages, kept = dict(corpus_pipeline.STAGES), docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "pii", "packing"]
    for name in ("language_id", "quality"):
        out = stages[name](spark, kept, SF)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").join(docs, "doc_id", "left_semi")
    assert good.join(kept, "doc_id", "left_anti").count() == 0  # clean documents stay
    before = {r.doc_id: r.text for r in kept.collect()}
    sets = _sets(before, 5)
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    home = _groups(sets, pairs)
    kept = spark.createDataFrame(stages["near_dedup"](spark, kept, SF).collect(), docs.schema)
    assert {r.doc_id for r in kept.collect()} == {d for d in sets if home[d] == d}
    clean = spark.createDataFrame(stages["pii"](spark, kept, SF).collect(), docs.schema)
    assert clean.count() == kept.count() and all(_base(r.text) == "" or "[" in r.text for r in clean.collect())
    assert clean.filter("n_chars <> length(text)").count() == 0
    packed = stages["packing"](spark, clean, SF)
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert packed.groupBy("bin_id").agg(F.sum("piece_tokens").alias("n")).filter("n > 4096").count() == 0
