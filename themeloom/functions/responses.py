"""Reading the JSON answers of a text-completion function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.functions.text import strip


def without_fence(response: Column) -> Column:
    """Drop a code fence; its last three characters go even if they are text."""
    text = strip(response)

    def inner(start: int) -> Column:
        return F.substr(text, F.lit(start), F.greatest(F.length(text) - (start + 2), F.lit(0)))

    return (
        F.when(F.startswith(text, F.lit("```json")), inner(8))
        .when(F.startswith(text, F.lit("```")), inner(4))
        .otherwise(text)
    )


def json_problem(body: Column) -> Column:
    """NULL for one whole JSON object, else the error class.

    The array wrap finds text after the first value, which the parser skips.
    """
    value = F.try_parse_json(body)
    one_value = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    return F.when(
        value.isNull() | ~F.coalesce(one_value, F.lit(False)), F.lit(fixed.JSON_PARSE_FAILED)
    ).when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(fixed.NOT_AN_OBJECT))


def parsed_answers(answers: DataFrame, schema: str) -> DataFrame:
    """Parse ``response`` by ``schema``; ``error`` tells why a row has no answer.

    Rows that already failed keep their message. All fields of the schema become
    columns, NULL on failed rows.
    """
    body = answers.withColumn("_body", without_fence(F.col("response")))
    marked = body.withColumn("error", F.coalesce(F.col("error"), json_problem(F.col("_body"))))
    parsed = marked.withColumn(
        "_answer", F.when(F.col("error").isNull(), F.from_json("_body", schema))
    )
    return parsed.select(*answers.columns, "_answer.*")


def parsed_topics(answers: DataFrame) -> DataFrame:
    """Topic answers: ``topics`` is an empty array on failure, never NULL.

    An answer whose topic lacks a name or description fails as a whole.
    """
    parsed = parsed_answers(answers, fixed.TOPICS_ANSWER)
    return _complete_items(parsed, "topics", fixed.TOPIC_TYPE, fixed.BAD_TOPIC)


def parsed_themes(answers: DataFrame) -> DataFrame:
    """Theme answers, with the same rule: ``themes`` is never NULL."""
    parsed = parsed_answers(answers, fixed.THEMES_ANSWER)
    return _complete_items(parsed, "themes", fixed.THEME_TYPE, fixed.BAD_THEME)


def _complete_items(parsed: DataFrame, items: str, kind: str, problem: str) -> DataFrame:
    incomplete = F.exists(items, lambda t: t.isNull() | t["name"].isNull() | t["description"].isNull())
    error = F.coalesce("error", F.when(incomplete, F.lit(problem)))
    return parsed.withColumn("error", error).withColumn(
        items,
        F.when(F.col("error").isNull() & F.col(items).isNotNull(), F.col(items)).otherwise(
            F.array().cast(f"array<{kind}>")
        ),
    )
