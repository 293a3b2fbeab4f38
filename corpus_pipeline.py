"""From raw documents to token files: the stages of a training-data corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and reads it back as the next stage's documents.

Defined cases: documents without a letter (null and empty texts too) go in the first stage;
rows of one id are one document, of which near-dedup keeps one row; rows without an id stay
there and are hashed by their text in the mix; a document that the mix takes several times is
written as often; very long texts are worked on whole; an empty table gives empty stages; all
other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontamination, language, mixing, near_dedup, token_files
from tallyforge.llm.common import stash, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language.accepted(docs, language.fit_language_model(docs))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.first_of_groups(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and their index read back from them."""
    return token_files.tokens_of(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_distinct),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", tokens),
]
#: Trained and sketched stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
