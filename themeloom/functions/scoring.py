"""Small rules on numbers and topic or theme texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom import fixed


def topic_text(name: Column, description: Column, phrases: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat_ws(" ", name, description, F.array_join(F.coalesce(phrases, none), " "))


def strength_copies(strength: Column) -> Column:
    known = F.coalesce(strength, F.lit(fixed.DEFAULT_STRENGTH))
    return F.greatest(F.lit(1), F.floor(known / 3).cast("int"))


def weighted_theme_text(themes: Column) -> Column:
    """One string per article: each theme's text repeated by its strength."""
    return F.array_join(
        F.flatten(
            F.transform(
                themes,
                lambda t: F.array_repeat(
                    F.concat(
                        t["name"],
                        F.lit(" "),
                        t["description"],
                        F.lit(" "),
                        F.coalesce(t["coverage"], F.lit("")),
                    ),
                    strength_copies(t["strength"]),
                ),
            )
        ),
        " ",
    )


def reduction_ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.bround((before - after) / before, 2)).otherwise(F.lit(0.0))


def cluster_count(articles: Column) -> Column:
    """An eighth of the articles, between two and ten, never above their number."""
    eighth = F.floor(articles / 8).cast("bigint")
    wanted = F.least(F.greatest(F.lit(2), eighth), F.lit(10))
    return F.least(wanted, articles).cast("int")


def is_success(error: Column, found: Column) -> Column:
    return error.isNull() & (F.array_size(found) > 0)
