"""The pipeline on a small table, and that the rest works without it."""

import corpus_pipeline as p
from pyspark.sql import functions as F

from assaykit.llm.signature_trees import near_duplicates
from assaykit.llm import pii


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "substrings", "pii", "packing"]
    now = docs
    for name, stage in p.STAGES:
        made = stage(spark, now, sf)
        if name != "packing":
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
        if name == "quality":
            assert 0.7 * docs.count() < made.count() < docs.count()
        if name == "near_duplicates":
            groups = near_duplicates(now, columns=["doc_id"])
            assert made.count() == groups.select("component_id").distinct().count()
        if name == "substrings":
            assert made.where(F.length("text") != F.col("n_chars")).count() == 0 and made.count() == now.count()
        if name == "pii":
            left = [e for r in now.select("doc_id", "text").collect() for e in [(r.doc_id, r.text[a:b]) for _, a, b in pii.find(r.text)]]
            texts = {r.doc_id: r.text for r in made.collect()}
            assert left and not any(v in texts[i] for i, v in left)
        now = spark.createDataFrame(made.collect(), made.schema) if name != "packing" else made
    assert now.count() > 0


def test_odd_documents(spark, sf):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (None, "", None, None, 0), (2, "word " * 70, "en", "s", 350), (3, "word " * 70 + "end", "en", "s", 353), (None, "mail a.b@c.example.com", "en", "s", 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[1:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    assert docs.count() == 6 and p.packing_stage(spark, docs, sf).count() >= 1
    for _, stage in p.STAGES[1:]:
        assert stage(spark, docs.where("false"), sf).count() == 0
