"""Queries of the text operators and of the pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from tabforge.llm import codes, divergence, language_model, mixing, ngram_join, passages, pieces, private, quality, simhash, topk, toxicity, winnowing
from tabforge.llm.common import table


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.fiftieth(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_query(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored_documents(table(spark, sf_dir, "documents"))


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.masked_documents(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.audited(table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_topk": op2_topk, "op3_quality": op3_quality, "op4_simhash": op4_simhash, "op5_mixing": op5_mixing, "op6_winnowing": op6_winnowing, "op7_pieces": op7_pieces, "op8_language_model": op8_language_model, "op9_private": op9_private, "op10_repeats": op10_repeats, "op11_codes": op11_codes, "op12_ngram_join": op12_ngram_join, "op13_divergence": op13_divergence, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.ORACLE, "op11_codes": codes.ORACLE, "op12_ngram_join": ngram_join.ORACLE, "op13_divergence": divergence.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
