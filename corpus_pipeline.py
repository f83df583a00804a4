"""Corpus pipeline: quality classifier, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``; a document that the mixture takes
twice is in it twice. The last returns doc_id, n_tokens, ids_sha256,
decoded_sha256 and ids.

Defined cases: null and empty texts have no perplexity and go in the first
stage; a stage that leaves no rows gives an empty table to the next; rows that
repeat a doc_id or have none are told apart by their texts; null languages and
sources are groups of their own; very long texts are taken whole; columns
beyond those of ``documents`` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from missive.llm import bpe, exact, jaccard, mixing, quality
from missive.llm.common import read
from missive.session import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose perplexity under the model of trusted text is too high go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each text stays."""
    return exact.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of linked documents stays."""
    return jaccard.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids, and digests of the ids and of the text decoded from them."""
    return bpe.bpe_digest(docs, with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The first stage trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
