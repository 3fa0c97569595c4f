"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Every stage takes nulls in any column, empty and
very long texts, equal and repeated rows and empty tables; what becomes of them is
said at each. Other columns are kept, whatever their names. Stages with Python bound the
session's Arrow batches, and leave that bound in place, as their results are computed later. SQL cannot express the classifier, the secret
patterns' checksums and the sampled segmentations, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import language_id, mixing, ngram_join, piece_sampling, secrets_scan
from threadloom.llm.shared import bound_batches, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without an identifiable language go, null and empty ones and those without a letter among them.

    The classifier learns from this stage's own documents with text and label;
    without any, all go. Repeated rows fare alike; null ids and sources do not matter.
    """
    bound_batches(spark)
    filters = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_identified(docs, filters)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose 5-word shingles have a similarity of 0.8 or more, the one with the least doc_id stays.

    Null ids come last; rows equal in id and text count as one; null texts and texts without words all stay.
    """
    bound_batches(spark)
    return ngram_join.keep_one(docs, words=5, num=4, den=5)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced by marks; all documents stay, null and empty texts as they are."""
    bound_batches(spark)
    clean = secrets_scan.redact_rows(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times; null and empty texts never. A null source is one of its own."""
    return mixing.mix_rows(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of each document, with token ids; a null or empty text has one, without tokens. Repeated rows have equal ones."""
    bound_batches(spark)
    return piece_sampling.sample(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", remove_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sample_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
