"""Built-in answers, so that every stage runs without a language model.

Each function gives the rows a completion function would: a JSON text in the
contract of its prompt. All of it is column work on the tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.functions.text import bigrams
from themeloom.operators.arrays import bound, by_value, runs
from themeloom.operators.skew import salted_join, split_groups
from themeloom.operators.terms import idf, term_counts, term_statistics, with_terms


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^.!?]*[.!?]?", 0)


def segment_topics(
    segments: DataFrame,
    key: str,
    number: str,
    text: str,
    max_topics: int,
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """``key, topic_no`` and topic fields: the heaviest segments of each article.

    Weight is the sum of tf-idf within the article; the name is the three
    heaviest terms, the phrases are the first three distinct bigrams.
    """
    segments = segments.where(F.col(key).isNotNull()).select(key, number, text)
    ordinary, large = split_groups(segments, [key], F.length(text))
    best = _best_in_rows(ordinary, key, number, text, max_topics, stop_words)
    if large is not None:
        best = best.unionByName(_spread_best(large, key, number, text, max_topics, stop_words))
    phrases = F.slice(F.array_distinct(bigrams(F.col("terms"))), 1, 3)
    return best.select(
        key,
        (F.col("rank") - 1).cast("int").alias("topic_no"),
        F.array_join("top", " ").alias("name"),
        first_sentence(F.col("_text")).alias("description"),
        phrases.alias("key_phrases"),
        F.greatest(F.lit(1), 11 - F.col("rank")).cast("double").alias("importance"),
        F.array("_text").alias("supporting_quotes"),
    )


def _best_in_rows(
    segments: DataFrame,
    key: str,
    number: str,
    text: str,
    max_topics: int,
    stop_words: Iterable[str] | None,
) -> DataFrame:
    """``key, rank, top, terms, _text``: only the texts are shuffled, once, by article.

    The rest is inside the article's row. Segments of one number are one segment
    with several texts; each of them counts as a text of its own for the idf.
    """
    texts = with_terms(segments.repartition(key), text, stop_words)
    row = F.struct(F.col(number).alias("no"), F.col(text).alias("text"), "terms")
    articles = texts.groupBy(key).agg(F.collect_list(row).alias("_rows"))
    articles = articles.select(
        key, F.array_size("_rows").alias("_texts"), by_value(F.col("_rows"), lambda r: r["no"]).alias("_segments")
    )

    terms_of = lambda r: F.coalesce(r["terms"], F.array().cast("array<string>"))

    def counted(segment: Column, i: Column) -> Column:
        """``term, i, tf, texts`` of each distinct term of a segment."""
        holding = lambda t: F.array_size(F.filter(segment["rows"], lambda r: F.array_contains(terms_of(r), t)))
        return F.transform(
            runs(F.sort_array(F.flatten(F.transform(segment["rows"], terms_of))), lambda t: t),
            lambda run: F.struct(
                F.get(run, F.lit(0)).alias("term"),
                i.alias("i"),
                F.array_size(run).alias("tf"),
                F.when(F.array_size(segment["rows"]) == 1, 1).otherwise(holding(F.get(run, F.lit(0)))).alias("texts"),
            ),
        )

    entries = F.sort_array(F.flatten(F.transform("_segments", counted)))

    def weighted(run: Column) -> Column:
        df = F.aggregate(run, F.lit(0), lambda acc, e: acc + e["texts"])
        weight = lambda f: F.transform(
            run, lambda e: F.struct(e["i"].alias("i"), (-F.round(e["tf"] * f, 6)).alias("w"), e["term"].alias("term"))
        )
        return bound(idf(F.col("_texts"), df), weight)

    weights = F.sort_array(F.flatten(F.transform(runs(entries, lambda e: e["term"]), weighted)))
    heads = F.transform(
        runs(weights, lambda e: e["i"]),
        lambda mine: F.struct(
            F.round(F.aggregate(mine, F.lit(0.0), lambda acc, e: acc + e["w"]), 4).alias("order"),
            F.get(F.col("_segments"), F.get(mine, F.lit(0))["i"])["id"].alias("no"),
            F.get(mine, F.lit(0))["i"].alias("i"),
            F.slice(mine["term"], 1, 3).alias("top"),
        ),
    )
    best = F.transform(
        F.slice(F.sort_array(heads), 1, max_topics),
        lambda h, n: F.struct(
            (n + 1).alias("rank"), h["top"].alias("top"), h["no"].alias("no"),
            F.get(F.col("_segments"), h["i"])["rows"].alias("rows"),
        ),
    )
    # a segment without a number takes a rank but gives no topic
    found = articles.select(key, F.explode(best).alias("b")).where(F.col("b.no").isNotNull())
    return found.select(key, "b.rank", "b.top", F.explode("b.rows").alias("r")).select(
        key, "rank", "top", "r.terms", F.col("r.text").alias("_text")
    )


def _spread_best(
    segments: DataFrame,
    key: str,
    number: str,
    text: str,
    max_topics: int,
    stop_words: Iterable[str] | None,
) -> DataFrame:
    """The same for articles of any size, by shuffles over (article, term)."""
    texts = with_terms(segments, text, stop_words)
    statistics = term_statistics(texts, [key])
    sizes = segments.groupBy(key).agg(F.count("*").alias("texts"))
    rated = statistics.join(sizes, key).select(
        key, "term", "df", idf(F.col("texts"), F.col("df")).alias("idf")
    )
    counts = term_counts(texts, [key, number])
    weights = salted_join(counts, rated, [key, "term"], "df", [number]).select(
        key, number, "term", F.round(F.col("tf") * F.col("idf"), 6).alias("w")
    )
    heads = weights.groupBy(key, number).agg(
        F.sum("w").alias("mass"),
        F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "term"))).alias("t"),
    )
    rank = F.row_number().over(
        W.partitionBy(key).orderBy(F.desc(F.round("mass", 4)), F.asc(number))
    )
    best = (
        heads.select(key, number, "mass", F.slice("t.term", 1, 3).alias("top"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= max_topics)
    )
    return best.join(texts.select(key, number, "terms", F.col(text).alias("_text")), [key, number]).select(
        key, "rank", "top", "terms", "_text"
    )


def topic_answers(
    segments: DataFrame,
    key: str,
    number: str,
    text: str,
    max_topics: int,
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """``key, response, error``; an article has at most ``max_topics`` topics."""
    topics = segment_topics(segments, key, number, text, max_topics, stop_words)
    fields = ["name", "description", "key_phrases", "importance", "supporting_quotes"]
    grouped = topics.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("topic_no", F.struct(*fields).alias("t")))).alias("l")
    )
    return grouped.select(
        key,
        F.to_json(F.struct(F.col("l.t").alias("topics"))).alias("response"),
        F.lit(None).cast("string").alias("error"),
    )


def theme_answers(records: DataFrame, keys: list[str], max_themes: int = 4) -> DataFrame:
    """``keys, response, error``: topics sharing their first name word form a theme.

    Works inside the record's topic array. Themes are ranked by number of topics,
    then mean importance, then word. Records without topics fail.
    """
    head = lambda t: F.split_part(t["name"], F.lit(" "), F.lit(1))
    importance = lambda t: F.coalesce(t["importance"], F.lit(fixed.DEFAULT_IMPORTANCE))
    topics = F.col("clustered_topics")

    def theme(word: Column) -> Column:
        mine = F.filter(topics, lambda t: head(t) == word)
        mean = F.aggregate(mine, F.lit(0.0), lambda acc, t: acc + importance(t)) / F.array_size(mine)
        return F.struct(
            (-F.array_size(mine)).alias("n"),
            (-F.round(mean, 6)).alias("i"),
            word.alias("word"),
            F.struct(
                word.alias("name"),
                F.get(mine, F.lit(0))["description"].alias("description"),
                F.transform(mine, lambda t: t["name"]).alias("related_topics"),
                F.bround(mean).alias("strength"),
                F.concat_ws(
                    " ",
                    F.array_size(mine).cast("string"),
                    F.lit("of"),
                    F.array_size(topics).cast("string"),
                    F.lit("topics"),
                ).alias("coverage"),
            ).alias("theme"),
        )

    ranked = F.array_sort(F.transform(F.array_distinct(F.transform(topics, head)), theme))
    themes = F.slice(F.transform(ranked, lambda x: x["theme"]), 1, max_themes)
    some = F.array_size(topics) > 0
    return records.select(
        *keys,
        F.when(some, F.to_json(F.struct(themes.alias("themes")))).alias("response"),
        F.when(~some, F.lit(fixed.NO_TOPICS)).alias("error"),
    )


def cluster_answers(themes: DataFrame, cluster: str = "cluster_number") -> DataFrame:
    """``cluster, response, error``: the theme names that carry most strength."""
    strength = F.coalesce("strength", F.lit(fixed.DEFAULT_STRENGTH))
    by_name = themes.groupBy(cluster, "name").agg(
        F.sum(strength).alias("weight"), F.count("*").alias("uses")
    )
    rank = F.row_number().over(
        W.partitionBy(cluster).orderBy(F.desc("weight"), F.desc("uses"), F.asc("name"))
    )
    top = by_name.withColumn("rank", rank).where(F.col("rank") <= 6)
    grouped = top.groupBy(cluster).agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "uses"))).alias("l")
    )
    names = F.col("l.name")
    answer = F.struct(
        F.array_join(F.slice(names, 1, 3), " ").alias("cluster_name"),
        F.get(names, F.lit(0)).alias("main_theme"),
        F.slice(names, 1, 3).alias("common_patterns"),
        F.slice(names, 4, 3).alias("distinguishing_features"),
        F.concat(F.lit("Themes: "), F.array_join(names, ", ")).alias("cluster_summary"),
    )
    return grouped.select(
        cluster, F.to_json(answer).alias("response"), F.lit(None).cast("string").alias("error")
    )
