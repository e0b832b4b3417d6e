"""One-row summaries and counts of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.functions.scoring import is_success


def stage1_summary(records: DataFrame) -> DataFrame:
    """Totals over the records; parts of one article count once."""
    rows = records.where(F.col("part_no") == 0)
    return rows.agg(
        F.lit(1).alias("stage"),
        F.lit(fixed.STAGE1_DESCRIPTION).alias("description"),
        F.count("*").alias("total_articles"),
        F.count_if(F.col("error").isNull()).alias("successful_articles"),
        F.count_if(F.col("error").isNotNull()).alias("failed_articles"),
        F.coalesce(F.sum("topics_count"), F.lit(0)).alias("total_original_topics"),
        F.coalesce(F.sum("clustered_count"), F.lit(0)).alias("total_clustered_topics"),
    )


def successful_records(records: DataFrame) -> DataFrame:
    return records.where(is_success(F.col("error"), F.col("clustered_topics")))


def stage2_summary(
    stage1: DataFrame, theme_records: DataFrame, key: str, clusters: int, score: float | None
) -> DataFrame:
    """Totals of stage 2 over all attempted articles; ``stage1`` is its summary row."""
    valid = is_success(F.col("error"), F.col("themes"))
    articles = theme_records.groupBy(key).agg(F.bool_or(F.coalesce(valid, F.lit(False))).alias("ok"))
    return articles.agg(
        F.lit(2).alias("stage"),
        F.lit(fixed.STAGE2_DESCRIPTION).alias("description"),
        F.count_if("ok").alias("articles_with_themes"),
        F.count_if(~F.col("ok")).alias("failed_articles"),
    ).select(
        "stage",
        "description",
        stage1.select("total_articles").scalar().alias("total_articles"),
        "articles_with_themes",
        "failed_articles",
        F.lit(fixed.CLUSTERING_METHOD).alias("clustering_method"),
        F.lit(clusters).alias("n_clusters"),
        F.lit(score).cast("double").alias("silhouette_score"),
    )


def corpus_totals(articles: DataFrame) -> DataFrame:
    """Documents and words taken in, documents that failed."""
    ok = F.col("error").isNull()
    return articles.agg(
        F.count("*").alias("documents"),
        F.count_if(ok).alias("inserted"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("word_count"))), F.lit(0)).alias("words"),
    )


def failure_counts(rows: DataFrame) -> DataFrame:
    """Rows per error message; success is the NULL message."""
    return rows.groupBy("error").agg(F.count("*").alias("rows"))
