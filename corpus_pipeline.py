"""A training corpus in five stages, each of which works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import mixing, near_dup, pieces, pii, quality_rules
from brindle.llm._common import discard, intermediates, new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates, by shingles of five words."""
    return near_dup.keep_one(docs, shingle=5)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms for personal data."""
    return pii.replace_texts(docs, key=pii.session_key(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of pieces of every document: doc_id, n_tokens, token_ids, round_trip."""
    # Workers still hold memory of the stages before: they remember fewer words than in a run of their own.
    return pieces.encode_texts(docs, pieces.Vocabulary.read(), remembered=75 << 20)


STAGES = [
    ("quality_rules", quality),
    ("near_dup", one_of_each),
    ("pii", private),
    ("mixing", mixed),
    ("pieces", tokens),
]

#: SQL has no SetSketch, Feistel network or Viterbi pass: the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`. Between stages rows go through Parquet in the shared folder.

    What a stage wrote for itself goes when its rows are written, and those when the next stage's are; only the last
    ones stay, which the result reads.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:
            discard(spark, [last])
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
