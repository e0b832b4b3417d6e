"""From raw documents to a training mix: five stages, each over all rows of the last.

Every stage but the last returns the columns of documents; the last adds copy_no. The
SQL counterpart is None: SimHash needs XXH64, which SQL lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm.decontaminate import keep_clean
from themeloom.llm.lines import dedup_lines
from themeloom.llm.mixing import mix
from themeloom.llm.quality import keep_good
from themeloom.llm.simhash import keep_one_of_each
from themeloom.operators.storage import written
from themeloom.shipping import ship

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
