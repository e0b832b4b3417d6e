"""Merging the topics of a leader group and the per-article records.

A group's members are collected in parts of at most ``block_rows`` topic
numbers. Ordinary groups have the single part 0. Larger ones have one row per
part: the texts are split over the parts, nothing is cut off, while name,
importance, quotes and size are those of the whole group on every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.functions.scoring import reduction_ratio
from themeloom.operators.storage import written

TOPIC_FIELDS = ["name", "description", "key_phrases", "importance", "supporting_quotes"]
MERGED_FIELDS = [*TOPIC_FIELDS, "merged_from", "cluster_size"]


def _strings(column: str | Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _part(number: Column, later: bool, block_rows: int) -> Column:
    return F.floor(number / block_rows).cast("int") if later else F.lit(0)


def merge_topics(
    topics: DataFrame,
    leaders: DataFrame,
    within: list[str],
    number: str,
    later: bool,
    block_rows: int = 1000,
    quotes: int = 3,
) -> DataFrame:
    """``within, leader_no, part_no, parts`` and the merged topic's fields.

    ``merged_from`` and ``cluster_size`` are NULL on topics that stayed alone.
    """
    group = [*within, "leader_no"]
    members = F.array_sort(F.collect_list(F.struct(F.col(number).alias("no"), *TOPIC_FIELDS)))
    if later:
        joined = topics.join(
            leaders.select(*within, number, "leader_no"), [*within, number], "left"
        ).withColumn("leader_no", F.coalesce("leader_no", F.col(number).cast("int")))
        rows = joined.withColumn("part_no", _part(F.col(number), later, block_rows))
        parts = rows.groupBy(*group, "part_no").agg(members.alias("m"))
    else:
        rows = _led_in_rows(topics, leaders, within, number)
        parts = rows.groupBy(*group).agg(members.alias("m")).withColumn("part_no", F.lit(0))
    # sums and bounded lists of each part, then of the whole group
    parts = parts.select(
        "*",
        F.array_size("m").alias("_size"),
        F.aggregate(
            "m",
            F.lit(0.0),
            lambda acc, t: acc + F.coalesce(t["importance"], F.lit(fixed.DEFAULT_IMPORTANCE)),
        ).alias("_importance"),
        F.slice("m.name", 1, 2).alias("_names"),
        F.slice(
            F.array_sort(
                F.array_distinct(
                    F.flatten(F.transform("m", lambda t: _strings(t["supporting_quotes"])))
                )
            ),
            1,
            quotes,
        ).alias("_quotes"),
    )
    if later:
        parts = _with_group_values(written(parts), rows, group, quotes)
    else:
        parts = parts.withColumn("parts", F.lit(1)).withColumn(
            "_phrases",
            F.array_sort(
                F.array_distinct(
                    F.flatten(F.transform("m", lambda t: _strings(t["key_phrases"])))
                )
            ),
        )
    alone = F.col("_size") == 1
    only = F.get("m", F.lit(0))
    return parts.select(
        *group,
        "part_no",
        "parts",
        F.array_join("_names", fixed.NAME_SEPARATOR).alias("name"),
        F.array_join("m.description", fixed.DESCRIPTION_SEPARATOR).alias("description"),
        F.when(alone, only["key_phrases"]).otherwise(_strings("_phrases")).alias("key_phrases"),
        F.when(alone, only["importance"])
        .otherwise(F.bround(F.col("_importance") / F.col("_size")))
        .alias("importance"),
        F.when(alone, only["supporting_quotes"]).otherwise(F.col("_quotes")).alias(
            "supporting_quotes"
        ),
        F.when(~alone, F.col("m.name")).alias("merged_from"),
        F.when(~alone, F.col("_size")).alias("cluster_size"),
    )


def _gathered(topics: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, _topics``: each article's topics in one row, in order.

    Merging and records both start from this: the same plan, so the topics are
    shuffled once for the two.
    """
    topic = F.struct(F.col(number).alias("no"), F.struct(*TOPIC_FIELDS).alias("t"))
    return topics.groupBy(*keys).agg(F.array_sort(F.collect_list(topic)).alias("_topics"))


def _led_in_rows(
    topics: DataFrame, leaders: DataFrame, within: list[str], number: str
) -> DataFrame:
    """Topics with ``leader_no``, their own number if they have none.

    The leaders come to the article's row, so that no text is moved to meet them
    and the rows stay laid out by article.
    """
    same_type = F.col(number).cast(topics.schema[number].dataType)
    own = F.coalesce("leader_no", F.col(number).cast("int"))
    taken = (
        leaders.where(F.col(number).isNotNull())
        .groupBy(*within, same_type.alias("_no"))
        .agg(F.collect_list(own).alias("_leaders"))
        .groupBy(*within)
        .agg(F.map_from_entries(F.collect_list(F.struct("_no", "_leaders"))).alias("_led"))
    )
    led = lambda x: F.struct(
        x.alias("x"), F.coalesce(F.element_at("_led", x["no"]), F.array(x["no"].cast("int"))).alias("leaders")
    )
    both = _gathered(topics, within, number).join(taken, within, "left")
    rows = both.select(*within, F.explode(F.transform("_topics", led)).alias("r"))
    return rows.select(*within, "r.x", F.explode("r.leaders").alias("leader_no")).select(
        *within, F.col("x.no").alias(number), "x.t.*", "leader_no"
    )


def _with_group_values(
    parts: DataFrame, rows: DataFrame, group: list[str], quotes: int
) -> DataFrame:
    """Replace the part's own sums and lists by those of its whole group.

    The texts stay where they are: group values are found on slim rows, limited
    per task, and come back by group and part, a key that no group crowds.
    """

    def first_of(values: DataFrame, order: list[str], kept: int, value: str, name: str):
        rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
        best = values.withColumn("_rank", rank).where(F.col("_rank") <= kept)
        return best.groupBy(*group).agg(
            F.array_sort(F.collect_list(F.struct("_rank", value))).alias("_l")
        ).select(*group, F.col(f"_l.{value}").alias(name))

    names = parts.select(*group, "part_no", F.posexplode("_names").alias("_pos", "_name"))
    quoted = parts.select(*group, F.explode("_quotes").alias("_quote")).distinct()
    totals = (
        parts.groupBy(*group)
        .agg(
            F.count("*").cast("int").alias("parts"),
            F.sum("_size").cast("int").alias("_size"),
            F.sum("_importance").alias("_importance"),
        )
        .join(first_of(names, ["part_no", "_pos"], 2, "_name", "_names"), group)
        .join(first_of(quoted, ["_quote"], quotes, "_quote", "_quotes"), group, "left")
        .withColumn("_quotes", _strings("_quotes"))
    )
    # a phrase is listed on the first part that has it
    phrases = (
        rows.select(*group, "part_no", F.explode("key_phrases").alias("phrase"))
        .groupBy(*group, "phrase")
        .agg(F.min("part_no").alias("part_no"))
        .groupBy(*group, "part_no")
        .agg(F.array_sort(F.collect_list("phrase")).alias("_phrases"))
    )
    by_part = [*group, "part_no"]
    return (
        parts.select(*by_part, "m")
        .join(parts.select(*by_part).join(totals, group), by_part)
        .join(phrases, by_part, "left")
    )


def article_records(
    articles: DataFrame,
    topics: DataFrame,
    merged: DataFrame,
    key: str,
    number: str,
    later: bool,
    block_rows: int = 1000,
) -> DataFrame:
    """One record per article and part, with original and merged topics nested.

    ``articles`` brings ``key``, any further columns and ``error``. Counts are
    those of the whole article; an article with no topics is a success with
    empty lists, a failed one has NULL counts.
    """
    by = [key, "part_no"]
    counted = topics.withColumn("part_no", _part(F.col(number), later, block_rows))
    # a constant part is no grouping key, so that one shuffle by article serves all
    keys = by if later else [key]
    original = _gathered(counted if later else topics, keys, number)
    clustered = merged.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("leader_no").alias("no"), F.struct(*MERGED_FIELDS).alias("t"))
            )
        ).alias("_merged")
    )
    if later:
        totals = (
            topics.groupBy(key)
            .agg(F.count("*").alias("_before"))
            .join(
                merged.select(key, "leader_no").distinct().groupBy(key).agg(
                    F.count("*").alias("_after")
                ),
                key,
                "left",
            )
        )
        slots = counted.select(*by).distinct().join(totals, key)
        # lists meet their article by article and part, which spreads hot articles
        base = articles.join(slots, key, "left").withColumn(
            "part_no", F.coalesce("part_no", F.lit(0))
        )
        lists = base.join(original, by, "left").join(clustered, by, "left")
    else:
        lists = (
            articles.join(original, key, "left")
            .join(clustered, key, "left")
            .withColumn("part_no", F.lit(0))
            .withColumn("_before", F.array_size("_topics").cast("bigint"))
            .withColumn("_after", F.array_size("_merged").cast("bigint"))
        )
    ok = F.col("error").isNull()
    before = F.coalesce("_before", F.lit(0))
    after = F.coalesce("_after", F.lit(0))
    # failed articles carry no topics into the record
    return lists.select(
        *articles.columns,
        "part_no",
        F.when(ok, F.coalesce(F.col("_topics.t"), _empty(topics, TOPIC_FIELDS))).alias(
            "original_topics"
        ),
        F.when(ok, F.coalesce(F.col("_merged.t"), _empty(merged, MERGED_FIELDS))).alias(
            "clustered_topics"
        ),
        F.when(ok, before).alias("topics_count"),
        F.when(ok, after).alias("clustered_count"),
        F.when(ok, reduction_ratio(before, after)).alias("reduction_ratio"),
    )


def _empty(rows: DataFrame, fields: list[str]) -> Column:
    kind = rows.select(*fields).schema.simpleString()
    return F.array().cast(f"array<{kind}>")
