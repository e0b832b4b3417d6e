"""Markdown articles: reading, and writing one text per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.text import word_count
from themeloom.operators.storage import written


def read_markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, filepath, content, word_count, error`` of a folder's ``.md`` files.

    A missing folder or one without such files is an error. A file that is not
    valid UTF-8 is a row with an ``error``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.md")
        .load(folder)
        .select(
            F.col("_metadata.file_name").alias("filename"),
            F.col("path").alias("filepath"),
            F.col("content").alias("data"),
        )
    )
    if files.select("filename").isEmpty():
        raise FileNotFoundError(f"no markdown files in {folder}")
    text = F.try_validate_utf8(F.col("data").cast("string"))
    # text mode turns every line end into a line feed
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return files.select(
        "filename",
        "filepath",
        unix.alias("content"),
        word_count(unix).alias("word_count"),
        F.when(text.isNull(), F.lit("not valid UTF-8")).alias("error"),
    )


def one_per_key(articles: DataFrame, key: str) -> DataFrame:
    """One row per key: a readable one if there is any, then the least content.

    Only the rows of repeated keys are moved; NULL keys stay as they are.
    """
    repeated = articles.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    repeated = written(repeated)
    fields = [c for c in articles.columns if c != key]
    order = F.struct(F.col("error").isNotNull(), "content", "error")
    kept = (
        articles.join(repeated, key, "left_semi")
        .groupBy(key)
        .agg(F.min_by(F.struct(*fields), order).alias("_row"))
        .select(key, "_row.*")
    )
    return articles.join(repeated, key, "left_anti").unionByName(kept)


def write_articles(articles: DataFrame, path: str) -> None:
    """The article table that later stages read."""
    articles.write.mode("overwrite").parquet(path)


def export_markdown(articles: DataFrame, path: str) -> None:
    """One folder of text per document, named by ``output_name``.

    Meant for hand-off to other tools; stages read the article table instead.
    """
    (
        articles.where(F.col("error").isNull())
        .select("output_name", "content")
        .write.mode("overwrite")
        .partitionBy("output_name")
        .text(path)
    )
