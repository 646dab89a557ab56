"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import compression, html_crf, lang_id, mixing, near_dup, pieces, pii, quality_rules, top_k, toxicity
from brindle.llm._common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), pieces.Vocabulary.read())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key=pii.session_key(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_quality_rules": op2_quality_rules,
    "op3_compression_classifier": op3_compression_classifier,
    "op4_near_dup": op4_near_dup,
    "op5_toxicity": op5_toxicity,
    "op6_lang_id": op6_lang_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_top_k": op8_top_k,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op8_top_k": top_k.TOP_K_SQL,
    "op9_mixing": mixing.MIX_SQL,
}
