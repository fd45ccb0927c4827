"""Corpus pipeline: toxic documents go, one of each class of near copies stays, contaminated documents go, secrets are
blanked, and what is left is packed.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.  All
but the last return the columns of documents.  A missing or null text goes through every stage as an empty one; ``n_chars``
follows the text where secrets were blanked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftsplit.llm import decontamination, near_duplicates, packing, secrets, toxicity
from riftsplit.llm.queries import table, training_labels
from riftsplit.plans.durable import ensure_checkpoint_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score 0.7 or more; the grammar is learned from this stage's documents that have a label."""
    labels = training_labels(table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.drop_toxic(docs, toxicity.learn_grammar(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the lowest id of each class: five-word shingles, similarity 0.8."""
    kept = near_duplicates.keep_one_of_each_class(docs, width=5, percent=80)
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item."""
    kept = decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return kept.select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blank the secrets in the texts; every document stays."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

# the toxicity grammar, signatures and tokens are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return docs
