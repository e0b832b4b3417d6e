"""Prompt texts and the lines they list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom import fixed

TOPIC_REQUEST = (
    "Read the interview below and list its main topics, at most {max_topics}.\n"
    "Give each topic a short name, one or two sentences of description, typical "
    "phrases, an importance from 1 to 10 and supporting quotes.\n"
)
TOPIC_ANSWER_SHAPE = (
    '{"topics": [{"name": "...", "description": "...", "key_phrases": ["..."], '
    '"importance": 8, "supporting_quotes": ["..."]}]}'
)
THEME_REQUEST = (
    "The topics below come from one interview. Name the two to four broad themes "
    "behind them.\nGive each theme a name, a description, the topics it covers, a "
    "strength from 1 to 10 and how much of the interview it covers.\n"
)
THEME_ANSWER_SHAPE = (
    '{"themes": [{"name": "...", "description": "...", "related_topics": ["..."], '
    '"strength": 8, "coverage": "..."}]}'
)
CLUSTER_REQUEST = (
    " related interviews carry the themes below. Say what unites them, which "
    "patterns recur and what sets the group apart, and name the group.\n"
)
CLUSTER_ANSWER_SHAPE = (
    '{"cluster_name": "...", "main_theme": "...", "common_patterns": ["..."], '
    '"distinguishing_features": ["..."], "cluster_summary": "..."}'
)
ANSWER_WITH = "\n\nAnswer with this JSON object only:\n"


def topic_prompt(content: Column, max_topics: int) -> Column:
    return F.concat(
        F.lit(TOPIC_REQUEST.format(max_topics=max_topics) + "\nInterview:\n"),
        content,
        F.lit(ANSWER_WITH + TOPIC_ANSWER_SHAPE),
    )


def shown_number(value: Column) -> Column:
    """8.0 as ``8`` and 8.5 as ``8.5``."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(
        value.cast("string")
    )


def topic_lines(topics: Column) -> Column:
    return F.array_join(
        F.transform(
            topics,
            lambda t: F.format_string(
                fixed.TOPIC_LINE_FORMAT,
                t["name"],
                t["description"],
                F.coalesce(shown_number(t["importance"]), F.lit("N/A")),
            ),
        ),
        "\n",
    )


def theme_prompt(topics: Column) -> Column:
    return F.concat(
        F.lit(THEME_REQUEST + "\nTopics:\n"),
        topic_lines(topics),
        F.lit(ANSWER_WITH + THEME_ANSWER_SHAPE),
    )


def theme_line(article: Column, name: Column, description: Column) -> Column:
    return F.format_string(fixed.THEME_LINE_FORMAT, article, name, description)


def cluster_prompt(articles_count: Column, lines: Column) -> Column:
    return F.concat(
        articles_count.cast("string"),
        F.lit(CLUSTER_REQUEST + "\nThemes:\n"),
        F.array_join(lines, "\n"),
        F.lit(ANSWER_WITH + CLUSTER_ANSWER_SHAPE),
    )


def search_sentence(name: Column, description: Column) -> Column:
    return F.format_string(fixed.SEARCH_FORMAT, name, description)
