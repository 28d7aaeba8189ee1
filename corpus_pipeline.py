"""From raw documents to packed training sequences, in five stages; counted as part of the subpackage llm.

Each stage gets the documents that the stage before kept, as a table read from Parquet, and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import packing, pii, quality
from assaykit.llm.common import ensure_checkpoint_dir
from assaykit.llm.queries import small_batches
from assaykit.llm.recompression import remove_repeated_words
from assaykit.llm.signature_trees import keep_one


def _with_text(docs: DataFrame, made: DataFrame, text: str) -> DataFrame:
    """The columns of docs, with ``text`` of made as their text and n_chars to match."""
    new = {"text": F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length(new["text"]), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return made.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.where(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles with a Jaccard similarity of 0.8 or more join."""
    small_batches(spark)
    return keep_one(docs, words=5, num=4, den=5)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every passage of 50 words or more that occurs elsewhere."""
    small_batches(spark)
    made = remove_repeated_words(docs, 50)
    return _with_text(docs, made, made.columns[-2])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the place of personal data and secrets."""
    small_batches(spark)
    return _with_text(docs, pii.replace(docs, pii.key_of(spark)), "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the trained, keyed and tokenised stages; the tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
