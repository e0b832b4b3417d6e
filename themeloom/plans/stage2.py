"""Stage 2: themes per article, articles clustered by theme, clusters described."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.functions.prompts import cluster_prompt, theme_prompt
from themeloom.functions.responses import parsed_answers, parsed_themes
from themeloom.functions.scoring import cluster_count, is_success, weighted_theme_text
from themeloom.operators import clusters as C
from themeloom.operators.describe_tree import describe_clusters
from themeloom.operators.completion import complete
from themeloom.operators.responder import cluster_answers, theme_answers
from themeloom.operators.rollups import stage1_summary, stage2_summary, successful_records
from themeloom.operators.silhouette import silhouette
from themeloom.operators.storage import written
from themeloom.operators.terms import corpus_features, fit_corpus, with_terms
from themeloom.settings import Settings


@dataclass(frozen=True)
class Stage2:
    summary: DataFrame
    clusters: DataFrame
    members: DataFrame
    themes: DataFrame
    centres: list[list[float]]


def theme_responses(
    records: DataFrame, key: str, respond: Callable[[str], str] | None
) -> DataFrame:
    """``key, part_no, response, error``; no topics fails without a call."""
    if respond is None:
        return theme_answers(records, [key, "part_no"])
    some = F.array_size("clustered_topics") > 0
    prompt = F.when(some, theme_prompt(F.col("clustered_topics")))
    asked = complete(records.select(key, "part_no", prompt.alias("prompt")), respond)
    error = F.when(F.col("prompt").isNull(), F.lit(fixed.NO_TOPICS)).otherwise(F.col("error"))
    return asked.select(key, "part_no", "response", error.alias("error"))


def theme_records(
    records: DataFrame, key: str, responses: DataFrame | None = None
) -> DataFrame:
    """``key, part_no, themes, source_topics_count, error`` of attempted articles."""
    if responses is None:
        responses = theme_responses(records, key, None)
    counts = records.select(
        key, "part_no", F.array_size("clustered_topics").alias("source_topics_count")
    )
    return (
        parsed_themes(responses)
        .join(counts, [key, "part_no"])
        .select(key, "part_no", "themes", "source_topics_count", "error")
    )


def themes_of(theme_rows: DataFrame, key: str, *carried: str) -> DataFrame:
    """Themes in long form; numbers go on over the parts of an article."""
    out = theme_rows.select(
        key, *carried, "part_no", F.posexplode_outer("themes").alias("_pos", "t")
    )
    number = (F.col("part_no") * 1000 + F.col("_pos")).alias("theme_no")
    return out.where(F.col("t").isNotNull()).select(key, *carried, number, "t.*")


def theme_texts(theme_rows: DataFrame, key: str) -> DataFrame:
    """Strength-weighted text of each article with themes.

    The parts of a large article are joined in order; themes are few per part.
    """
    valid = theme_rows.where(is_success(F.col("error"), F.col("themes")))
    part = F.struct("part_no", weighted_theme_text(F.col("themes")).alias("text"))
    if valid.where(F.col("part_no") > 0).isEmpty():
        return valid.select(key, part["text"].alias("text"))
    parts = valid.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return parts.select(key, F.array_join("p.text", " ").alias("text"))


def article_vectors(texts: DataFrame, key: str, settings: Settings) -> DataFrame:
    """``key, features``: dense TF-IDF over one- and two-word terms."""
    words = written(with_terms(texts.select(key, "text"), "text").select(key, "terms"))
    return corpus_features(words, [key], fit_corpus(words, settings.article_terms, pairs=True), pairs=True)


def cluster_analysis(
    assigned_themes: DataFrame,
    sizes: DataFrame,
    key: str,
    settings: Settings,
    respond: Callable[[str], str] | None,
) -> DataFrame:
    """One described row per cluster with its article and theme counts."""
    counts = C.cluster_theme_counts(assigned_themes)
    base = sizes.join(counts, "cluster_number", "left")
    if respond is None:
        answers = cluster_answers(assigned_themes)
    else:
        # every theme reaches a prompt: batches described, descriptions combined
        answers, _ = describe_clusters(assigned_themes, sizes, key, respond)
    parsed = parsed_answers(answers, fixed.CLUSTER_ANSWER).drop("response")
    missing = F.when(F.coalesce("themes_analyzed", F.lit(0)) == 0, F.lit(fixed.NO_THEMES))
    described = C.with_analysis(base, parsed)
    return described.withColumn("error", F.coalesce(missing, "error")).select(
        F.format_string(
            fixed.CLUSTER_ID_FORMAT, F.col("cluster_number").cast("string")
        ).alias("cluster_id"),
        "cluster_number",
        "size",
        "cluster_name",
        "main_theme",
        "common_patterns",
        "distinguishing_features",
        "cluster_summary",
        F.col("size").alias("articles_count"),
        F.coalesce("themes_analyzed", F.lit(0)).alias("themes_analyzed"),
        "display_name",
        "display_theme",
        "error",
    )


def stage2(
    records: DataFrame,
    key: str,
    settings: Settings = Settings(),
    respond: Callable[[str], str] | None = None,
) -> Stage2:
    """Cluster the articles of the stage 1 records; fewer than two is an error.

    Theme answers, article vectors and the assignment are written tables: each
    is read several times, and k-means and silhouette iterate over them.
    """
    attempted = successful_records(records)
    answers = written(theme_responses(attempted, key, respond))
    themes = written(theme_records(attempted, key, answers))
    texts = theme_texts(themes, key)
    vectors = written(article_vectors(texts, key, settings))
    articles = vectors.count()
    if articles < 2:
        raise ValueError(fixed.TOO_FEW_ARTICLES)
    k = settings.n_clusters
    if k is None:
        k = vectors.agg(cluster_count(F.count("*")).alias("k")).first()["k"]
    k = min(k, articles)
    fitted = C.fit_kmeans(
        vectors,
        key,
        "features",
        k,
        settings.kmeans_seeds,
        settings.kmeans_max_iter,
        settings.kmeans_tol,
    )
    assigned = fitted.assigned
    score = silhouette(
        assigned.join(vectors, key), key, "cluster_number", "features", settings.block_rows
    ).first()
    sizes = C.cluster_sizes(assigned)
    assigned_themes = themes_of(themes, key).join(assigned, key)
    analysis = cluster_analysis(assigned_themes, sizes, key, settings, respond)
    summary = stage2_summary(
        stage1_summary(records), themes, key, k, score["silhouette_score"]
    )
    return Stage2(
        summary,
        written(analysis),
        C.cluster_members(assigned, key),
        themes,
        fitted.centres,
    )
