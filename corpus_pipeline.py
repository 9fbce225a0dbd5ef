"""A document table cleaned and packed in five stages; each works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents: doc_id, text,
lang, source, n_chars (of the text as it now is). Nulls, empty and very long texts, repeated rows and empty
tables are handled as the operators' own docstrings say; extra columns do not pass on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import packing, quality, secrets, simhash, substring_dedup
from souk.llm.common import id_text, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # trained weights and fingerprints are beyond SQL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier grades low or toxic."""
    model = quality.fit(id_text(docs), quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs, model, carry=COLUMNS).where("keep").select("carried.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the document with the least id."""
    return simhash.first_of_groups(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes windows of 50 words that a document with a smaller id has; a text that nothing is left of goes."""
    out = substring_dedup.dedup_substrings(docs, carry=["lang", "source", "n_chars"])
    whole = F.col("n_removed") == 0
    kept = out.where("n_removed = 0 or n_removed < n_words")
    return kept.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.when(whole, F.col("carried.n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    out = secrets.redact(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences, one row for each piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("secrets", secrets_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
