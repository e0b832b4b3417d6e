"""Stage 1: topics of each article, near duplicates merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.functions.prompts import topic_prompt
from themeloom.functions.responses import parsed_topics
from themeloom.functions.scoring import topic_text
from themeloom.functions.text import content_windows
from themeloom.operators.completion import complete
from themeloom.operators.grouping import has_later_blocks, topic_leaders
from themeloom.operators.merging import article_records, merge_topics
from themeloom.operators.responder import topic_answers
from themeloom.operators.storage import written
from themeloom.operators.terms import tfidf_vectors, with_terms
from themeloom.settings import Settings

LINE_END = "\n"


def topic_vectors(topics: DataFrame, key: str, settings: Settings) -> DataFrame:
    """TF-IDF vectors of topic texts, fitted inside each article."""
    text = topic_text(F.col("name"), F.col("description"), F.col("key_phrases"))
    texts = with_terms(topics.select(key, "topic_no", text.alias("text")), "text")
    return tfidf_vectors(texts, [key, "topic_no"], settings.topic_terms, [key])


def merged_topics(topics: DataFrame, key: str, settings: Settings) -> DataFrame:
    later = has_later_blocks(topics, "topic_no", settings.block_rows)
    return _merged(topics, key, settings, later)


def _merged(topics: DataFrame, key: str, settings: Settings, later: bool) -> DataFrame:
    leaders = topic_leaders(
        topic_vectors(topics, key, settings),
        [key],
        "topic_no",
        settings.similarity_threshold,
        later,
        settings.block_rows,
    )
    return merge_topics(
        topics, leaders, [key], "topic_no", later, settings.block_rows, settings.kept_quotes
    )


def records_of(articles: DataFrame, topics: DataFrame, key: str, settings: Settings) -> DataFrame:
    """Stage 1 records from articles and their topics in long form."""
    later = has_later_blocks(topics, "topic_no", settings.block_rows)
    merged = _merged(topics, key, settings, later)
    return article_records(articles, topics, merged, key, "topic_no", later, settings.block_rows)


def segments_of(articles: DataFrame, key: str) -> DataFrame:
    """Non-blank lines of each article as ``key, segment_no, text``."""
    pieces = F.filter(F.split("content", LINE_END), lambda p: F.trim(p) != "")
    out = articles.select(key, F.posexplode_outer(pieces).alias("segment_no", "text"))
    return out.where(F.col("segment_no").isNotNull())


def topic_prompts(articles: DataFrame, key: str, settings: Settings) -> DataFrame:
    """``key, window_no, prompt``: one prompt per window of each article."""
    windows = content_windows(F.col("content"), settings.content_cap)
    parts = articles.select(key, F.posexplode_outer(windows).alias("window_no", "part"))
    return parts.select(
        key,
        F.coalesce("window_no", F.lit(0)).alias("window_no"),
        topic_prompt(F.col("part"), settings.max_topics).alias("prompt"),
    )


def topic_responses(
    articles: DataFrame, key: str, settings: Settings, respond: Callable[[str], str] | None
) -> DataFrame:
    """``key, window_no, response, error`` for every readable article.

    ``respond`` is asked once per window of ``settings.content_cap`` characters, over
    the whole article. Without it the built-in answers are used, one row per article;
    one for which they find nothing answers with an empty list.
    """
    readable = articles.where(F.col("error").isNull())
    if respond is not None:
        windows = topic_prompts(readable, key, settings)
        return complete(windows, respond).select(key, "window_no", "response", "error")
    answers = topic_answers(
        segments_of(readable, key), key, "segment_no", "text", settings.max_topics
    )
    return readable.select(key).join(answers, key, "left").select(
        key, F.lit(0).alias("window_no"), F.coalesce("response", F.lit('{"topics":[]}')).alias("response"), "error"
    )


def topics_of(parsed: DataFrame, key: str) -> DataFrame:
    """Topics in long form, numbered from zero in answer order."""
    out = parsed.select(key, F.posexplode_outer("topics").alias("topic_no", "t"))
    return out.where(F.col("topic_no").isNotNull()).select(key, "topic_no", "t.*")


def parsed_responses(articles: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Topics per article with word count and method, or the error.

    The topics of its windows are joined in order; an article of which one window
    fails has that window's error and no topics.
    """
    window = F.struct("window_no", "topics", "error")
    windows = parsed_topics(responses).groupBy(key).agg(F.array_sort(F.collect_list(window)).alias("w"))
    failed = F.get(F.filter("w.error", lambda e: e.isNotNull()), F.lit(0))
    topics = F.when(failed.isNull(), F.flatten("w.topics")).otherwise(
        F.array().cast(f"array<{fixed.TOPIC_TYPE}>")
    )
    return (
        windows.select(key, topics.alias("topics"), failed.alias("error"))
        .join(articles.select(key, "word_count"), key)
        .withColumn("extraction_method", F.lit(fixed.EXTRACTION_METHOD))
    )


def stage1(
    articles: DataFrame,
    key: str,
    settings: Settings = Settings(),
    responses: DataFrame | None = None,
) -> DataFrame:
    """Records of all articles; ``responses`` defaults to the built-in answers.

    ``articles`` has ``key, content, word_count, error`` and any columns to carry;
    ``responses`` has what ``topic_responses`` gives.
    """
    if responses is None:
        responses = topic_responses(articles, key, settings, None)
    # read by vectors, merging and records alike
    parsed = written(parsed_responses(articles, responses, key))
    topics = topics_of(parsed, key)
    kept = [c for c in articles.columns if c not in ("content", "error")]
    outcome = articles.join(
        parsed.select(key, F.col("error").alias("_failed")), key, "left"
    ).select(*kept, F.coalesce("error", "_failed").alias("error"))
    return records_of(outcome, topics, key, settings)
