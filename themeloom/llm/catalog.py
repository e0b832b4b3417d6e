"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from themeloom.llm import (
    decontaminate, language, lines, merkle, mixing, pieces, pii, quality, secrets, simhash, toxicity, warc, whitening
)
from themeloom.llm.sql import LLM_SQL
from themeloom.shipping import ship

__all__ = ["LLM_QUERIES", "LLM_SQL"]

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[run.__name__] = lambda spark, folder: run(ship(spark), folder)
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages"))


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


@query
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"))


@query
def op5_benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ).drop("_key")


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


@query
def op9_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, folder, "documents")).drop("_key")


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_report(table(spark, folder, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest_report(table(spark, folder, "documents"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
