"""JSON results of the two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from themeloom import fixed
from themeloom.operators.rollups import successful_records

MERGED_TYPE = fixed.TOPIC_TYPE[:-1] + ", merged_from: ARRAY<STRING>, cluster_size: INT>"

STAGE1_RECORD = (
    "filename STRING, filepath STRING, word_count BIGINT, error STRING, part_no INT, "
    f"original_topics ARRAY<{fixed.TOPIC_TYPE}>, clustered_topics ARRAY<{MERGED_TYPE}>, "
    "topics_count BIGINT, clustered_count BIGINT, reduction_ratio DOUBLE"
)


def write_stage1(records: DataFrame, summary: DataFrame, folder: str) -> None:
    """One JSON record per article beside a one-row summary."""
    records.write.mode("overwrite").json(f"{folder}/stage1_articles")
    summary.write.mode("overwrite").json(f"{folder}/stage1_summary")


def read_stage1(spark: SparkSession, folder: str) -> DataFrame:
    """Records of stage 1; a missing result is an error of the reader."""
    return spark.read.schema(STAGE1_RECORD).json(f"{folder}/stage1_articles")


def read_stage1_successes(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with no error and at least one merged topic."""
    return successful_records(read_stage1(spark, folder))


def write_stage2(
    summary: DataFrame, clusters: DataFrame, members: DataFrame, themes: DataFrame, folder: str
) -> None:
    """Stage 2 as JSON: summary, clusters with their analysis, members, themes.

    Members are rows, one folder per cluster: a cluster may hold any number.
    """
    summary.write.mode("overwrite").json(f"{folder}/stage2_summary")
    clusters.write.mode("overwrite").json(f"{folder}/stage2_clusters")
    members.write.mode("overwrite").partitionBy("cluster_number").json(f"{folder}/stage2_members")
    themes.write.mode("overwrite").json(f"{folder}/stage2_article_themes")
